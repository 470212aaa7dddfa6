"""Incremental ingest and attribute evolution."""

from pyspark.sql import functions as F

from graphloom.operators import ingest as I
from tests.conftest import rows


def _m(**kv):
    return {k: v for k, v in kv.items()}


def test_discover_types_base_unsafe_null_first(spark):
    el = spark.createDataFrame(
        [(1, _m(population="2100000", capital="true", NODE='"x"', name='"n"', entity_name='"e"')),
         (2, _m(area_km2="105.4", **{"bad key": "1", "good_key": '"v"'})),
         (3, _m(late="null")), (4, _m(late="5000")), (5, _m(never="null"))],
        "o int, attrs map<string,string>")
    got = dict((r["column"], r["type"]) for r in I.discover_attr_columns(el, seq=F.col("o")).collect())
    assert got == {"population": "BIGINT", "capital": "BOOLEAN", "area_km2": "DOUBLE", "good_key": "VARCHAR",
                   "late": "BIGINT", "never": "VARCHAR"}


def test_evolve_never_changes_declared_type(spark):
    dec = spark.createDataFrame([("k", "BIGINT")], "column string, type string")
    new = spark.createDataFrame([("k", "VARCHAR"), ("x", "DOUBLE")], "column string, type string")
    assert rows(I.evolve_columns(dec, new)) == [("k", "BIGINT"), ("x", "DOUBLE")]


def test_coerce_values(spark):
    df = spark.createDataFrame([("a", _m(i='"3.7"', j="3.7", b='"Yes"', c='"nope"', d="0", s="12"))],
                               "NODE string, attrs map<string,string>")
    r = I.coerce_attrs(df, {"i": "BIGINT", "j": "BIGINT", "b": "BOOLEAN", "c": "BOOLEAN", "d": "BOOLEAN",
                            "s": "VARCHAR"}).collect()[0]
    assert (r["i"], r["j"], r["b"], r["c"], r["d"], r["s"]) == (None, 3, True, False, False, "12")


def test_merge_nodes_and_edges_rerun_creates_nothing(spark):
    nodes = spark.createDataFrame([("n1", "City", _m(population="1")), ("n2", "City", _m(area="2.0")),
                                   (None, "City", _m())], "id string, label string, attrs map<string,string>")
    edges = spark.createDataFrame([("e1", "n1", "n2", "NEAR", _m()), ("e2", "n1", "zz", "NEAR", _m())],
                                  "id string, src string, dst string, label string, attrs map<string,string>")
    s0n, s0e = I.empty_nodes(spark), I.empty_edges(spark)
    n1 = I.merge_nodes(s0n, nodes, "2025-01-01 00:00:00")
    e1 = I.merge_edges(s0e, edges, n1, "2025-01-01 00:00:00")
    rep1 = I.ingest_report(s0n, s0e, nodes, edges, n1).collect()[0]
    assert (rep1["nodes"], rep1["nodes_created"], rep1["edges"], rep1["edges_created"]) == (2, 2, 1, 1)
    n1, e1 = n1.cache(), e1.cache()
    upd = spark.createDataFrame([("n1", "Town", _m(population="5", mayor='"x"'))],
                                "id string, label string, attrs map<string,string>")
    n2 = I.merge_nodes(n1, upd, "2025-01-02 00:00:00")
    r = {x["NODE"]: x for x in n2.collect()}
    assert r["n1"]["attrs"] == {"population": "5", "mayor": '"x"'}
    assert str(r["n1"]["first_seen_ts"]).startswith("2025-01-01") and str(r["n1"]["last_seen_ts"]).startswith("2025-01-02")
    assert r["n1"]["labels"] == ["Town"] and set(r["n1"]["label_set"]) == {"City", "Town"}
    rep2 = I.ingest_report(n1, e1, nodes, edges, n1).collect()[0]
    assert (rep2["nodes_created"], rep2["edges_created"]) == (0, 0)


def test_label_keys_axis_table(spark):
    n = spark.createDataFrame([(["Company", "AI"],), (["Person"],)], "labels array<string>")
    assert rows(I.materialize_label_keys(n)) == [("EntityType", ["AI", "Company", "Person"])]


def test_promote_columns_fixtures(spark):
    nodes = spark.createDataFrame([("n1", "party"), ("n2", "party"), ("n3", "party")], "NODE string, LABEL string")
    wide = spark.createDataFrame([("n1", "Acme"), ("n2", "Beta"), ("n3", None), ("n9", "Ghost")],
                                 "NODE string, `party:party_name` string")
    out, stats = I.promote_columns(nodes, wide, "NODE", ["party:party_name"])
    s = stats.collect()[0]
    assert (s["nodes_matched"], s["properties_set"]) == (2, 2)
    assert rows(out.filter(F.col("`party:party_name`") == "Acme").select("NODE")) == [("n1",)]
    assert out.count() == 3
    nodes2 = spark.createDataFrame([("b1", None, None), ("b2", None, None)], "NODE string, a int, b int")
    wide2 = spark.createDataFrame([("b1", 1, None), ("b2", None, None), (None, 5, 6)], "NODE string, a int, b int")
    out2, st2 = I.promote_columns(nodes2, wide2, "NODE", ["a", "b"])
    assert rows(out2) == [("b1", 1, None), ("b2", None, None)]
    again, _ = I.promote_columns(out2, wide2, "NODE", ["a", "b"])
    assert rows(again) == rows(out2)
