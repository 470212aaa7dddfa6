"""Sketches per batch against exact counts."""
from pyspark.sql import functions as F

from graphloom.operators import sketches as K
from graphloom.session import scratch_path
from tests.conftest import rows


def test_merged_estimates_are_within_the_bound(spark):
    log = K.sketch_log(spark, scratch_path(spark, "sketches"))
    nodes = spark.range(60_000).select(F.concat(F.lit("v"), "id").alias("NODE"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 4)).alias("LABEL"), "id")
    parts = [nodes.filter("id < 30000"), nodes.filter("id >= 20000 and id < 50000"), nodes.filter("id >= 45000")]    # they overlap
    for k, p in enumerate(parts):
        for _ in range(2):      # each with its replay
            log.append(K.sketch_rows(p, "LABEL", "NODE"), f"{k:02d}")
    exact = dict(rows(nodes.groupBy("LABEL").agg(F.count_distinct("NODE").alias("n")), "LABEL", "n"))
    got = dict(rows(log.current()))
    bound = 4 * 1.04 / 2 ** (K.LG_K / 2)
    assert set(got) == set(exact) and all(abs(got[x] - exact[x]) <= bound * exact[x] for x in exact)
    assert abs(K.total(log).first()["n"] - 60_000) <= bound * 60_000
    log.compact()
    assert len(log.batches()) == 1 and dict(rows(log.current())) == got


def test_nulls_and_empty(spark):
    log = K.sketch_log(spark, scratch_path(spark, "sketches"))
    assert log.current().count() == 0 and K.total(log).first()["n"] == 0
    log.append(K.sketch_rows(spark.createDataFrame([("a", None), (None, "x"), (None, "y")], "g string, v string"), "g", "v"), "1")
    assert rows(log.current()) == sorted([("a", 0), (None, 2)], key=repr)
