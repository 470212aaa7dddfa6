import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers (mapInPandas with functions defined in tests) import from here.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.join(ROOT, "tests")] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="gl-test-ckpt-")
    s = get_spark("local[*]", shuffle_partitions=8, extra={"spark.checkpoint.dir": ckpt,
                                                          "spark.driver.memory": "4g"})
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples of the given columns."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
