"""Graph build (B1-B6) on small literal specs."""

from pyspark.sql import functions as F

from graphloom.operators import build as B
from tests.conftest import rows


def _vertexes(spark):
    return spark.createDataFrame(
        [("n1", "party", "Acme", None, 1), ("b1", "bank", None, "First", 2), ("n1", "person", None, None, 3),
         (None, "party", "Ghost", None, 4), ("n2", "party", "Beta", None, 5)],
        "node_id string, label string, party_name string, bank_name string, o int")


def test_build_nodes_merge_labels_and_last_non_null(spark):
    spec = B.NodeSpec(_vertexes(spark), id="node_id", label_column="label",
                      properties=["party_name", "bank_name"], order_by=["o"])
    n = B.build_nodes(spark, [spec])
    got = {r["NODE"]: r for r in n.collect()}
    assert set(got) == {"n1", "b1", "n2"}                      # null id dropped
    assert got["n1"]["LABEL"] == "person"                      # last label
    assert got["n1"]["labels"] == ["person", "party"]          # set accumulates, last first
    assert got["n1"]["party_name"] == "Acme"                   # null never erases


def test_build_edges_needs_both_endpoints_and_merges(spark):
    nodes = B.build_nodes(spark, [B.NodeSpec(_vertexes(spark), id="node_id", label_column="label")])
    e = spark.createDataFrame(
        [("e1", "n1", "b1", "OWNS", 1.0), ("e1", "n1", "b1", "OWNS", 2.0), ("e2", "n1", "zz", "OWNS", 1.0),
         ("e3", None, "b1", "OWNS", 1.0)], "edge_id string, node1 string, node2 string, label string, w double")
    spec = B.EdgeSpec(e, id="edge_id", source_key="node1", target_key="node2", type_column="label",
                      properties=["w"], order_by=["w"])
    out = B.build_edges(spark, [spec], nodes)
    assert rows(out, "ID", "src", "dst", "type", "w") == [("e1", "n1", "b1", "OWNS", 2.0)]


def test_build_counts_first_label_and_dropped_report(spark):
    v = _vertexes(spark)
    spec = B.NodeSpec(v, id="node_id", label_column="label", order_by=["o"])
    e = spark.createDataFrame([("e1", "n1", "b1"), ("e2", "n1", "zz"), ("e1", "n1", "b1")],
                              "edge_id string, s string, d string")
    es = B.EdgeSpec(e, id="edge_id", source_key="s", target_key="d", type="OWNS")
    counts = {(r["kind"], r["name"]): r["n"] for r in B.build_counts(spark, [spec], [es]).collect()}
    assert counts == {("node", "party"): 2, ("node", "bank"): 1, ("edge", "OWNS"): 1}
    rep = {(r["kind"], r["reason"]): r["n"] for r in B.dropped_rows_report(spark, [spec], [es]).collect()}
    assert rep[("node", "null_id")] == 1 and rep[("node", "duplicate")] == 1
    assert rep[("edge", "missing_endpoint")] == 1 and rep[("edge", "duplicate")] == 1


def test_check_identifiers(spark):
    df = spark.createDataFrame([("a", "good_label"), ("b", "bad label"), ("c", None)], "id string, l string")
    viol = B.check_identifiers(spark, [B.NodeSpec(df, id="id", label_column="l", properties=["party:name"])], [])
    vals = {(r["kind"], r["value"]) for r in viol.collect()}
    assert vals == {("node_label", "bad label"), ("node_label", None), ("property_key", "party:name")}


def test_create_graph_sql_contract(spark):
    spark.createDataFrame([("a", "Person", "Ann"), ("b", "Org", "Bee")], "NODE string, LABEL string, name string") \
        .createOrReplaceTempView("t_nodes")
    spark.createDataFrame([("a", "b", "WORKS_AT")], "NODE1 string, NODE2 string, LABEL string") \
        .createOrReplaceTempView("t_edges")
    g = B.create_graph_sql(spark, ["SELECT * FROM t_nodes"], ["SELECT * FROM t_edges"])
    assert "entity_name" in g.nodes.columns and "name" not in g.nodes.columns
    assert rows(g.edges, "ID", "src", "dst", "type") == [("a->b|WORKS_AT", "a", "b", "WORKS_AT")]


def test_creation_ledger_latest_and_bad_json(spark):
    r = spark.createDataFrame(
        [("g", "duckdb", "s1", "src", "2025-01-01 00:00:00", '{"a": 1}'),
         ("g", "duckdb", "s2", "src", "2025-01-02 00:00:00", "{bad"),
         ("g", "engine_b", "s3", "src", "2025-01-01 00:00:00", '{"b": 2}')],
        "graph string, engine string, statement string, source string, ts string, spec_json string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    out = {(x["engine"]): x for x in B.creation_ledger_latest(r, "g").collect()}
    assert out["duckdb"]["statement"] == "s2" and out["duckdb"]["spec"] is None
    assert out["engine_b"]["statement"] == "s3"


def _shop(spark):
    nodes = [B.NodeSpec(spark.range(40).select(F.concat(F.lit("a"), "id").alias("id"), F.col("id").alias("x")), id="id", label="A", properties=["x"]),
             B.NodeSpec(spark.range(30).select(F.concat(F.lit("b"), "id").alias("id")), id="id", label="B")]
    e = spark.range(60).select(F.col("id").alias("k"), F.concat(F.lit("a"), F.col("id") % 40).alias("s"), F.concat(F.lit("b"), F.col("id") % 30).alias("d"), F.col("id").alias("w"))
    return nodes, [B.EdgeSpec(e, "k", "s", "d", type="OWNS", properties=["w"]), B.EdgeSpec(e, "k", "s", "d", type="SEES")]


def test_rows_without_repeats_are_not_moved(spark):
    """A build without repeated keys and without dangling ends shuffles no row."""
    ns, es = _shop(spark)
    nodes = B.build_nodes(spark, ns)
    for df in (nodes, B.build_edges(spark, es, nodes)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan, plan
    assert B.build_edges(spark, es, nodes).count() == 120


def test_repeated_keys_and_dangling_ends_however_many(spark, monkeypatch):
    ns, es = _shop(spark)
    again = spark.createDataFrame([("a1", 100), ("a1", None), ("a2", 7), (None, 1)], "id string, x long")
    ns.append(B.NodeSpec(again, id="id", label="A", properties=["x"], order_by=["x"]))
    more = spark.createDataFrame([("1", "a1", "b1", 50), ("1", "a1", "b1", None), ("99", "zz", "b1", 1), ("99", "a1", "yy", 1), ("99", None, "b1", 1), ("70", "a7", "b7", 3)], "k string, s string, d string, w long")
    es += [B.EdgeSpec(more, "k", "s", "d", type="OWNS", properties=["w"], order_by=["w"]), B.EdgeSpec(more, "k", "s", "d", type="SEES")]
    seen = []
    for limit in (B.REPEATED, 0):
        monkeypatch.setattr(B, "REPEATED", limit)
        nodes = B.build_nodes(spark, ns)
        edges = B.build_edges(spark, es, nodes)
        seen.append((rows(nodes, "NODE", "LABEL", "x"), rows(edges, "ID", "src", "dst", "type", "w")))
    assert seen[0] == seen[1]
    got = {r[0]: r[2] for r in seen[0][0]}
    assert len(got) == len(seen[0][0]) == 70 and (got["a1"], got["a2"], got["a3"]) == (100, 7, 3)
    owns = {r[0]: r[4] for r in seen[0][1] if r[3] == "OWNS"}
    assert len(seen[0][1]) == 122 and owns["1"] == 50 and owns["2"] == 2 and owns["70"] == 3 and "99" not in owns


def test_many_repeated_keys_are_told_apart_by_bits(spark, monkeypatch):
    """More hashes of repeated keys than are broadcast: rows of other keys still do not go to the merge."""
    df = spark.range(4000).select(F.concat(F.lit("k"), F.when(F.col("id") < 200, F.col("id") % 100).otherwise(F.col("id"))).alias("k"), "id")
    for limit in (64, 7):
        monkeypatch.setattr(B, "REPEATED", limit)
        once, many = B._split_repeated(df, ["k"])
        assert once is not None and once.columns == many.columns == ["k", "id"]
        assert sorted(map(tuple, once.union(many).collect())) == sorted(map(tuple, df.collect()))
        assert once.select("k").distinct().count() == once.count() and many.filter("id < 200").count() == 200
        assert many.count() < 1200
