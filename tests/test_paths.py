"""Counting traversal against the enumerating form, on random graphs with hubs."""
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.match import E, N, match
from graphloom.operators.paths import _runs, count_paths


@pytest.fixture(scope="module")
def g(spark):
    rng = random.Random(11)
    nodes = [(f"v{i:02d}", "PQ"[i % 2], ["PQ"[i % 2]], float(i) if i % 7 else None) for i in range(40)]
    edges = []
    for k in range(260):
        a = "v00" if k % 3 == 0 else f"v{rng.randrange(40):02d}"        # a hub with a third of the edges
        b = "v01" if k % 5 == 0 else a if k % 17 == 0 else f"v{rng.randrange(40):02d}"
        edges.append((None if k % 50 == 0 else f"e{k}", a, b, rng.choice("STU"), k % 10))
    edges += edges[:6]                                                    # repeated rows
    n = spark.createDataFrame(nodes, "NODE string, LABEL string, labels array<string>, x double")
    return PropertyGraph(n, spark.createDataFrame(edges, "ID string, src string, dst string, type string, w int"))


def p(*parts):
    return list(parts)


def patterns():
    return [
        p(N("a", "P"), E(type="S"), N("b"), E(type="T"), N("c", "Q")),
        p(N("a"), E(type="S"), N("b", "P"), E(type="T", direction="<-"), N("c"), E(type="U", direction="-"), N("d")),
        p(N("a"), E(type="S"), N("b"), E(type="S", direction="<-"), N("c", "P")),
        p(N("a"), E(type=["S", "T"]), N("b", "Q"), E(type="T", direction="-"), N("c"), E(type="U"), N("d")),
        p(N("a"), E(direction="-"), N("b"), E(direction="-"), N("c")),
        p(N("a", "P"), E(type="S"), N("b"), E(type="S"), N("c"), E(type="S", direction="-"), N("d")),
        p(N("a"), E(type="S"), N("b"), E(type="T"), N("c"), E(type="S", direction="<-"), N("d")),
        p(N("a"), E(type="S", where=F.col("w") < 7), N("b", where=F.col("x") > 3), E(type="S", direction="<-", where=F.col("w") > 2), N("c")),
        p(N("a", "P")),
        p(N("a"), E(type="none"), N("b")),
    ]


@pytest.mark.parametrize("k", range(10))
def test_counts_equal_the_joined_matches(g, k):
    pattern = patterns()[k]
    aliases = [n.alias for n in pattern[0::2]]
    rich = [N(n.alias, n.label, n.where, ["x"]) if isinstance(n, N) else n for n in pattern]
    paths = match(g, rich).cache()
    for at in aliases:
        values = {f"sum_{v}": (v, "x") for v in aliases}
        got = count_paths(g, pattern, at, values)
        want = paths.groupBy(F.col(f"{at}.NODE").alias("NODE")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"{v}.x").alias(f"sum_{v}") for v in aliases])
        key = lambda df: sorted((r["NODE"], r["n"], *(None if r[f"sum_{v}"] is None else round(r[f"sum_{v}"], 6) for v in aliases)) for r in df.collect())
        assert key(got) == key(want), at
    paths.unpersist()


def test_runs():
    e = lambda t: E(type=t)
    assert _runs([e("S"), e("T"), e("U")]) == [(0, 0), (1, 1), (2, 2)]
    assert _runs([e("S"), e("S"), e("U")]) == [(0, 1), (2, 2)]
    assert _runs([e("S"), e("T"), e("S"), e("U")]) == [(0, 2), (3, 3)]


def test_no_join_of_two_edge_tables(g):
    """A hop joins edges to one row per node: what leaves it is grouped before the next hop."""
    plan = count_paths(g, patterns()[0], "a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") >= 2 and "Generate" not in plan
