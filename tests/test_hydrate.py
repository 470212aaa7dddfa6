"""Hydration, post-join and type helpers."""

from decimal import Decimal

from pyspark.sql import functions as F

from graphloom.functions.types import decimals_to_double
from graphloom.graph import PropertyGraph
from graphloom.operators import hydrate as H
from graphloom.sources import files as S
from tests.conftest import rows


def test_hydrate_overwrites_and_last_duplicate_wins(spark):
    res = spark.createDataFrame([("b1", "old", 1), ("b1", "old", 2), ("b9", "keep", 3), (None, "x", 4)],
                                "NODE string, name string, r int")
    wide = spark.createDataFrame([("b1", "Acme", 10.5, 1), ("b1", None, 3.0, 2), ("b2", "Beta", 3.0, 1)],
                                 "NODE string, name string, amount double, v int")
    out = H.hydrate(res, wide, "NODE", order_by=["v"])
    assert rows(out, "NODE", "name", "r", "amount") == [("b1", None, 1, 3.0), ("b1", None, 2, 3.0),
                                                         ("b9", "keep", 3, None)]


def test_post_join_empty_gives_no_rows(spark):
    empty = spark.createDataFrame([], "c_node string")
    wide = spark.createDataFrame([("party-A", "Acme")], "NODE string, name string")
    out = H.post_join(empty, wide, "SELECT COUNT(*) AS n FROM cypher")
    assert out.count() == 0
    res = spark.createDataFrame([("party-A",), ("party-A",), ("party-B",)], "c_node string")
    wide = spark.createDataFrame([("party-A", "Acme"), ("party-B", "Beta")], "NODE string, name string")
    out = H.post_join(res, wide, "SELECT w.name, COUNT(*) AS n FROM cypher c JOIN wide w ON w.NODE = c.c_node "
                                 "GROUP BY w.name ORDER BY n DESC")
    assert out.collect()[0]["name"] == "Acme"


def test_post_join_rows_from_graph_attributes(spark):
    nodes = spark.createDataFrame([("a", "x", "NYC"), ("b", "x", "SF"), ("c", "x", "LA")],
                                  "NODE string, LABEL string, city string")
    g = PropertyGraph(nodes, spark.createDataFrame([], "ID string, src string, dst string, type string"))
    res = spark.createDataFrame([("a",), ("b",)], "id string")
    out = H.post_join_rows(g, res, "SELECT w.city, COUNT(*) AS n FROM cypher c JOIN wide w ON w.NODE = c.id GROUP BY w.city")
    assert rows(out) == [("NYC", 1), ("SF", 1)]


def test_cascade_falls_through(spark):
    res = spark.createDataFrame([("a",)], "id string")
    empty = spark.createDataFrame([], "NODE string, v string")
    file_ = spark.createDataFrame([("a", "x")], "NODE string, v string")
    sql = "SELECT w.v FROM cypher c JOIN wide w ON w.NODE = c.id"
    assert H.post_join_cascade(res, [("graph", empty), ("source", file_)], sql).collect()[0]["hydrate_from"] == "source"
    assert H.post_join_cascade(res, [("graph", empty)], sql).collect()[0]["hydrate_from"] is None


def test_candidate_ids_and_decimals(spark):
    res = spark.createDataFrame([("a", "b", 1), ("a", None, 2)], "x string, y string, z int")
    assert rows(H.candidate_ids(res)) == [("a",), ("b",)]
    d = spark.createDataFrame([("b1", Decimal("10.50"))], "NODE string, amount decimal(10,2)")
    assert dict(decimals_to_double(d).dtypes)["amount"] == "double"


def test_infer_column_types_rules(spark):
    df = spark.createDataFrame([('{"a": 1, "b": true, "c": 1, "d": "x", "e": null}',),
                                ('{"a": 2, "b": false, "c": 2.5, "d": 3, "e": null}',)], "j string")
    got = dict((r["column"], r["type"]) for r in H.infer_column_types(df, "j").collect())
    assert got == {"a": "BIGINT", "b": "BOOLEAN", "c": "DOUBLE", "d": "VARCHAR", "e": "VARCHAR"}


def test_read_columns_and_detect_format(spark):
    wide = spark.createDataFrame([("b1", "Acme", 1.0)], "NODE string, `party:party_name` string, amount double")
    out = S.read_columns(wide, "NODE", ["NODE", "party:party_name"])
    assert out.columns == ["NODE", "party:party_name"]
    assert S.detect_format("s3a://x/y.JSONL?v=1") == "json" and S.detect_format("a/b.tsv") == "csv"
    assert S.table_name_for("/x/2024-sales.v1.csv") == "t_2024_sales"


def test_rank_by_path_count_golden(spark):
    paths = spark.createDataFrame([("p1",), ("p1",), ("p1",), ("p2",), ("p2",), ("p3",)], "NODE string")
    wide = spark.createDataFrame([("p1", "name1"), ("p2", "name2"), ("p3", "name3")], "NODE string, name string")
    out = H.rank_by_path_count(paths, wide, "NODE", "name").collect()
    assert [(r["name"], r["n"]) for r in out] == [("name1", 3), ("name2", 2), ("name3", 1)]
