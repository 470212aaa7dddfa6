"""Pattern matching (D1-D17) on a tiny graph."""

import os

from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import match as M
from graphloom.operators.match import E, N
from tests.conftest import rows


def tiny(spark):
    nodes = spark.createDataFrame(
        [("p1", "party", ["party"], "Ann Lee", 10.0), ("p2", "party", ["party"], "Bob", 90.0),
         ("b1", "bank", ["bank", "Entity"], "Acme", None), ("t1", "tin", ["tin"], None, None)],
        "NODE string, LABEL string, labels array<string>, name string, risk double")
    edges = spark.createDataFrame(
        [("e1", "p1", "b1", "USES"), ("e2", "p2", "b1", "USES"), ("e3", "p1", "t1", "HAS"),
         ("e4", "b1", "b1", "SELF")], "ID string, src string, dst string, type string")
    return PropertyGraph(nodes, edges)


def test_match_mixed_directions(spark):
    g = tiny(spark)
    m = M.match(g, [N("a", "party"), E(type="USES"), N("b", "bank"), E(type="USES", direction="<-"), N("c", "party")])
    # Relationship uniqueness: the same USES edge is not reused.
    assert rows(m.select(F.col("a.NODE").alias("a"), F.col("c.NODE").alias("c"))) == [("p1", "p2"), ("p2", "p1")]
    m2 = M.match(g, [N("a", "party"), E(type="USES"), N("b", "bank"), E(type="USES", direction="<-"), N("c", "party")],
                 unique_edges=False)
    assert m2.count() == 4


def test_undirected_self_loop_once(spark):
    g = tiny(spark)
    m = M.match(g, [N("a", where=F.col("NODE") == "b1"), E("r", direction="-"), N("b")])
    assert rows(m.select(F.col("r.ID").alias("id"))) == [("e1",), ("e2",), ("e4",)]


def test_not_exists_and_name_loose_and_optional_attr(spark):
    g = tiny(spark)
    assert rows(M.not_exists(g, N("p", "party"), [E(type="HAS"), N("t", "tin")]).select("p.NODE")) == [("p2",)]
    assert rows(M.match_nodes(g, where=M.name_matches("ACM")).select("NODE")) == [("b1",)]
    assert rows(M.match_nodes(g, where=M.name_matches("t1")).select("NODE")) == [("t1",)]
    assert rows(M.match_nodes(g, where=F.col("risk") > 20).select("NODE")) == [("p2",)]


def test_path_value_and_result_subgraph(spark):
    g = tiny(spark)
    m = M.match(g, [N("a", "party"), E("r", "USES"), N("b", "bank")])
    res = m.select(F.col("a.NODE").alias("x"), M.path_value(["a", "b"], ["r"]).alias("p"))
    nodes, edges = M.result_subgraph(res)
    assert rows(nodes) == [("b1", "bank"), ("p1", "party"), ("p2", "party")]
    assert rows(edges.select("id")) == [("e1",), ("e2",)]


def test_hops_to_graph_fixture(spark):
    hops = spark.createDataFrame(
        [("bank1", "wire1", '["bank"]', '["wire"]', '["SENT"]', "wire1", "tx1", '["wire"]', '["tx"]', '["PAID"]'),
         ("bank1", "wire2", '["bank"]', '["wire"]', '["SENT"]', "wire2", "tx2", '["wire"]', '["tx"]', '["PAID"]')],
        "NODE1_HOP_1 string, NODE2_HOP_1 string, NODE1_LABELS_HOP_1 string, NODE2_LABELS_HOP_1 string, "
        "EDGE_LABELS_HOP_1 string, NODE1_HOP_2 string, NODE2_HOP_2 string, NODE1_LABELS_HOP_2 string, "
        "NODE2_LABELS_HOP_2 string, EDGE_LABELS_HOP_2 string")
    nodes, edges = M.hops_to_graph(hops, 2)
    assert nodes.count() == 5 and edges.count() == 4
    assert ("bank1->wire1|SENT",) in rows(edges.select("id"))


def test_hops_to_graph_reads_its_rows_once(spark):
    rows_in = [("a->b", "c", '["x"]', "y", "R", 2), ("a", "b->c", None, "", '["R"]', 1), ("a->b", None, '["z"]', "w", None, 1),
               ("c", "d", '["v"]', '["q","r"]', None, 3), ("c", "d", "y", '["q"]', "", 3), ("ü", "d", "", "[bad", "S|T", 4)]
    hops = spark.createDataFrame(rows_in, "NODE1_HOP_1 string, NODE2_HOP_1 string, NODE1_LABELS_HOP_1 string, "
                                 "NODE2_LABELS_HOP_1 string, EDGE_LABELS_HOP_1 string, _row int").repartition(3)
    for df, first in ((hops, "z"), (hops.drop("_row"), "x")):
        nodes, edges = M.hops_to_graph(df, 1)
        assert rows(nodes) == [("a", None), ("a->b", first), ("b->c", None), ("c", "v" if first == "x" else "y"), ("d", "[bad" if first == "x" else "q"), ("ü", None)]
        # Two edges share an id: one of them stays, as the id is the key.
        assert rows(edges) == [("a->b->c|R", "a", "b->c", "R"), ("c->d|", "c", "d", None), ("ü->d|S|T", "ü", "d", "S|T")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        both = nodes.select("id").unionByName(edges.select("id"))
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Generate explode") == 1 and "ReusedExchange" in plan


def test_node_attrs_and_records(spark):
    g = tiny(spark)
    ids = spark.createDataFrame([("p1",), ("p1",), ("zz",)], "NODE string")
    a = M.node_attrs(g, ids)
    assert a.columns == ["NODE", "name", "risk"] and rows(a) == [("p1", "Ann Lee", 10.0)]
    assert M.get_record(g, "nope").count() == 0


def test_start_hop_same_result(spark):
    g = tiny(spark)
    pat = [N("a", "party"), E("r1", "USES"), N("b", "bank"), E("r2", "USES", direction="<-"), N("c", "party")]
    base = rows(M.match(g, pat).select("a.NODE", "b.NODE", "c.NODE", "r1.ID", "r2.ID"))
    for s in (1, 2, "c"):
        assert rows(M.match(g, pat, start=s).select("a.NODE", "b.NODE", "c.NODE", "r1.ID", "r2.ID")) == base


def test_name_index_equals_the_scan(spark):
    import random
    from graphloom.graph import PropertyGraph
    from graphloom.operators import name_index as NI
    from graphloom.operators.match import name_matches
    from graphloom.session import scratch_path
    from graphloom.sources import store
    rng = random.Random(6)
    nodes = [(f"N{i}", "P", ["P"] if i % 2 else ["Q"], rng.choice([None, "", "Äbc", "".join(rng.choices("aAbBc ", k=rng.randrange(12)))])) for i in range(400)]
    n = spark.createDataFrame(nodes, "NODE string, LABEL string, labels array<string>, name string")
    root = scratch_path(spark, "names")
    store.write_graph(spark, PropertyGraph(n, spark.createDataFrame([], "ID string, src string, dst string, type string")), root, "g")
    NI.write_names(spark, root, "g")
    for q in ("abc", "ABCA", "a b", "bb", "", "äb", "äBC", "n12", "aaaa", "zzz"):
        got = NI.find_names(spark, root, "g", q, props=["name"])
        assert rows(got, "NODE", "name") == rows(n.filter(name_matches(q)), "NODE", "name"), q
    assert "Exchange" not in NI.postings(store.read_graph(spark, root, "g").nodes)._jdf.queryExecution().executedPlan().toString()
    plan = NI.find_names(spark, root, "g", "abca", "P")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [abc,bca])" in plan
    store.write_graph(spark, store.read_graph(spark, root, "g"), root, "g")      # rebuilt: no stale index
    assert not os.path.exists(store.table_path(root, "g", store.NAMES)) and NI.find_names(spark, root, "g", "abc").count() > 0


def test_paths_carry_each_id_once_and_leaves_join_edges_first(spark):
    """No join of the chain gets more than the ids of its paths; the last node joins the edges, not the paths."""
    from graphloom.plans.q_graph import _paths
    from graphloom.plans.tpch import tpch_graph
    m = _paths(tpch_graph(spark, "/root/testdata/sf0.001")).select("c.NODE", "o.NODE", "p.NODE", "e1.ID", "e2.ID")
    widths, todo = [], [m._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            widths += [c.output().size() for c in children]
        todo += children
    assert len(widths) == 8 and max(widths) <= 3


def test_match_gives_whole_structs_for_any_order(spark):
    """Ends, types and directions of edges come out of the ids of the path."""
    g = tiny(spark)
    g.meta["stats"] = {"nodes": 4, "labels": {"party": 2, "bank": 1, "Entity": 1, "tin": 1},
                       "types": {"USES": (2, 2, 1), "HAS": (1, 1, 1), "SELF": (1, 1, 1)}}
    pattern = [N("a", "party"), E("x", "USES"), N("b", "bank", props=["name"]), E("y", ["USES", "SELF"], direction="-"), N("c", props=["risk"])]
    want = [("p1", "Acme", "e1", "p1", "b1", "USES", "e2", "p2", "b1", "USES", "p2", 90.0), ("p1", "Acme", "e1", "p1", "b1", "USES", "e4", "b1", "b1", "SELF", "b1", None),
            ("p2", "Acme", "e2", "p2", "b1", "USES", "e1", "p1", "b1", "USES", "p1", 10.0), ("p2", "Acme", "e2", "p2", "b1", "USES", "e4", "b1", "b1", "SELF", "b1", None)]
    assert M._leaf_first(g, pattern, 0, 2)
    for start in (None, 0, 1, 2):
        m = M.match(g, pattern, start=start)
        assert sorted(m.columns) == ["a", "b", "c", "x", "y"]
        assert m.schema["x"].dataType.fieldNames() == ["ID", "src", "dst", "type"]
        assert sorted(map(tuple, m.select("a.NODE", "b.name", "x.*", "y.*", "c.NODE", "c.risk").collect()), key=lambda r: (r[0], r[6])) == sorted(want, key=lambda r: (r[0], r[6]))


def test_result_subgraph_reads_its_rows_once(spark):
    g = tiny(spark)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        m = M.match(g, [N("a", "party"), E("r", "USES"), N("b", "bank")])
        nodes, edges = M.result_subgraph(m.select("a", M.path_value(["a", "b"], ["r"]).alias("p")))
        both = nodes.select("id", "label").unionByName(edges.select("id", F.col("type").alias("label")))
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan.split("Generate")[-1] and plan.count("Generate") == 1
        assert rows(both) == [("b1", "bank"), ("e1", "USES"), ("e2", "USES"), ("p1", "party"), ("p2", "party")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_result_subgraph_of_arrays_and_missing_cells(spark):
    """Cells that are null, lists with nulls, labels out of ``labels``, an id that is a node and an edge."""
    df = spark.createDataFrame([((("n1", None),), None, [("k", "a", "b")]), (None, [("n1", ["Entity", "x"]), None], None)],
                               "c struct<n:struct<NODE:string,LABEL:string>>, l array<struct<NODE:string,labels:array<string>>>, e array<struct<ID:string,src:string,dst:string>>")
    nodes, edges = M.result_subgraph(df.select("c.n", "l", "e", F.struct(F.lit("k").alias("NODE"), F.lit("z").alias("LABEL")).alias("k")))
    key = lambda r: tuple("" if x is None else x for x in r)
    assert sorted(map(tuple, nodes.collect()), key=key) == [(None, None), ("k", "z"), ("n1", "x")]
    assert rows(edges) == [("k", "a", "b", None)]
