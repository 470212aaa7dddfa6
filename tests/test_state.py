"""Batch logs, document ingest into them, stored graphs and recipes:
what a crash, a repeated document or a small batch does to them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.doc_ingest import GraphStore, ingest_documents, state_graph
from graphloom.operators.match import E, N, match, result_subgraph
from graphloom.operators import ingest as I
from graphloom.operators.batch_log import keyed, new_batch_id
from graphloom.session import scratch_path
from graphloom.sources import fs, store
from graphloom.sources.lineage import source_lineage
from tests.conftest import rows


def table(spark, keep="last"):
    return keyed(spark, scratch_path(spark, "table"), "k long, v string", ["k"], keep)


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def test_a_crash_and_its_replay(spark):
    t = table(spark)
    t.append(frame(spark, (1, "a"), (2, "a")), "01")
    # A batch that was cut off: Spark's commit did not happen.
    os.makedirs(f"{t.root}/batch=02/_temporary/0")
    open(f"{t.root}/batch=02/_temporary/0/part-0.parquet", "w").close()
    assert rows(t.current()) == [(1, "a"), (2, "a")]
    for _ in range(2):          # the replay, and the same again
        t.append(frame(spark, (2, "b"), (3, "b")), "02")
        assert rows(t.current()) == [(1, "a"), (2, "b"), (3, "b")]
    assert rows(t.current(skip="02")) == [(1, "a"), (2, "a")]


def test_two_writers_lose_nothing(spark):
    t, other = table(spark), None
    t.append(frame(spark, (1, "a"), (2, "a")), new_batch_id())
    other = keyed(spark, t.root, "k long, v string", ["k"])
    a, b = new_batch_id(), new_batch_id()
    read_before = t.current()           # writer A has read, B writes, A writes
    other.append(frame(spark, (2, "B")), b)
    t.append(read_before.filter("k = 1").withColumn("v", F.lit("A")), a)
    assert rows(t.current()) == [(1, "A"), (2, "B")]


def test_compaction_changes_nothing(spark):
    log = I.node_log(spark, scratch_path(spark, "nodes"))
    batch = lambda *r: spark.createDataFrame(list(r), "id string, label string, name string, attrs map<string,string>, o int")
    log.append(I.node_rows(batch(("a", "X", "Ann", {"p": "1", "q": "1"}, 1), ("b", "X", None, None, 2)), "2025-01-01 00:00:00", "01", F.col("o")), "01")
    log.append(I.node_rows(batch(("a", "Y", None, {"q": "2"}, 1)), "2025-01-02 00:00:00", "02", F.col("o")), "02")
    want = rows(log.current())
    assert [(r[0], r[1], sorted(r[2]), r[4], r[5]) for r in want] == [("a", ["Y"], ["X", "Y"], "Ann", {"p": "1", "q": "2"}), ("b", ["X"], ["X"], None, {})]
    assert str(want[0][6]) < str(want[0][7])
    # Half done: the merged batch stands, the old ones too.
    log.append(log.merge(log.rows()), "02+")
    assert rows(log.current()) == want
    log.compact()
    assert len(log.batches()) == 1 and rows(log.current()) == want
    # A batch that started before the compaction and ends after it keeps its place.
    log.append(I.node_rows(batch(("a", "Z", "Zoe", {"p": "0", "r": "0"}, 1)), "2025-01-01 12:00:00", "015", F.col("o")), "015")
    a = rows(log.current())[0]
    assert (a[1], a[4], a[5]) == (["Y"], "Zoe", {"p": "0", "q": "2", "r": "0"})


def test_the_log_equals_merging_batch_by_batch(spark):
    """Against C1/C2 as frame operators."""
    nl, el = I.node_log(spark, scratch_path(spark, "n")), I.edge_log(spark, scratch_path(spark, "e"))
    n, e = I.empty_nodes(spark), I.empty_edges(spark)
    for k in range(4):
        now, at = f"2025-01-0{k + 1} 00:00:00", f"{k:02d}"
        nb = spark.createDataFrame([(f"n{(i * (k + 2)) % 11}", "ABC"[i % 3], {f"k{i % 4}": str(i + k)}, i) for i in range(9)], "id string, label string, attrs map<string,string>, o int")
        eb = spark.createDataFrame([(f"e{i % 5}", f"n{i % 7}", f"n{(i + k) % 12}", None if i == 3 else "T", {f"k{i % 2}": str(i * k)}, i) for i in range(12)],
                                   "id string, src string, dst string, label string, attrs map<string,string>, o int")
        n = I.merge_nodes(n, nb, now, F.col("o")).checkpoint()
        e = I.merge_edges(e, eb.filter("label is not null"), n, now, F.col("o")).checkpoint()
        nl.append(I.node_rows(nb, now, at, F.col("o")), at)
        el.append(I.edge_rows(eb.filter("label is not null"), now, at, F.col("o"), nodes=nl.rows()), at)
    plain = lambda df: sorted(str(sorted((k, sorted(v.items()) if isinstance(v, dict) else sorted(v) if k == "label_set" else v) for k, v in r.asDict().items())) for r in df.collect())
    assert plain(nl.current()) == plain(n) and plain(el.current()) == plain(e)


def test_a_replayed_ingest_is_the_ingest(spark):
    s = GraphStore(spark, scratch_path(spark, "docs"), "w.g")
    first = ingest(spark, s, [("u", "Alder Brook and Cedar", 1)], batch_id="01")
    again = ingest(spark, s, [("u", "Alder Brook and Cedar", 1)], batch_id="01")
    assert first == again and first["nodes_created"] == 2
    s.compact()
    assert ingest(spark, s, [("u", "Alder Brook and Cedar", 1)], batch_id="02")["reused"] == 1 and s.nodes.current().count() == 2


def test_last_label_of_a_streamed_node(spark):
    from graphloom.streaming import ingest_stream as ST
    base = scratch_path(spark, "stream")
    spark.createDataFrame([("a", "Z"), ("b", "Q"), ("a", "A")], "NODE string, LABEL string").coalesce(1).write.parquet(base + "/in/f1")
    out = ST.stream_schema_counts(spark, base + "/in/*", "NODE string, LABEL string", base + "/state", base + "/ck")
    assert rows(out) == [("A", 1), ("Q", 1)]


def test_an_edge_waits_for_its_ends(spark):
    from graphloom.streaming import ingest_stream as ST
    base, cols = scratch_path(spark, "stream"), "kind string, id string, label string, src string, dst string, _ord long"
    ticks = iter(["2025-01-01 00:00:00", "2025-01-01 00:00:10", "2025-01-01 00:00:20"])
    put = lambda name, *r: spark.createDataFrame(list(r), cols).coalesce(1).write.parquet(f"{base}/in/{name}")
    put("f1", ("edge", "e1", "R", "a", "b", 1), ("edge", "e2", "R", "a", "zz", 2), ("node", "a", "X", None, None, 3))
    n, e, p = ST.stream_tables(spark, base + "/in/*", cols, base + "/st", base + "/ck", clock=lambda: next(ticks))
    assert e.count() == 0 and rows(p, "id") == [("e1",), ("e2",)]
    put("f2", ("node", "b", "X", None, None, 4))
    n, e, p = ST.stream_tables(spark, base + "/in/*", cols, base + "/st", base + "/ck", clock=lambda: next(ticks))
    assert [(r[0], str(r[1])) for r in rows(e, "ID", "first_seen_ts")] == [("e1", "2025-01-01 00:00:10")]
    assert rows(ST.overdue(p, "2025-01-01 00:01:00", 30), "id", "waiting_sec") == [("e2", 60)]


def ingest(spark, s, docs, now="2025-01-01 00:00:00", **kw):
    df = spark.createDataFrame(docs, "doc_uri string, text string, ord long")
    return ingest_documents(spark, s, df, now, **kw).first().asDict()


def test_repeated_uris_and_places(spark):
    s = GraphStore(spark, scratch_path(spark, "docs"), "w.g")
    docs = [("u", "Alder Brook and Cedar", 1), ("u", "Alder Brook and Dune", 2), ("v", "Elm Field and Fern", 1), ("u", "Alder Brook and Dune", 3)]
    r = ingest(spark, s, docs)
    assert (r["documents"], r["processed"], r["reused"]) == (4, 3, 1)
    assert rows(s.nodes.current(), "NODE") == [("Alder Brook",), ("Cedar",), ("Dune",), ("Elm Field",), ("Fern",)]
    assert {n: raw for n, raw in rows(s.nodes.current(), "NODE", "label_raw")}["Elm Field"] == ["Name"]
    assert rows(s.texts.current(), "doc_uri", "text") == [("u", "Alder Brook and Dune"), ("v", "Elm Field and Fern")]
    assert r["nodes"] == r["nodes_created"] == 5 and r["edges"] == r["edges_created"] == 3
    # The same clock again: nothing is created twice.
    r = ingest(spark, s, [("w", "Cedar and Gorse", 1), ("v", "Elm Field and Fern", 2)])
    assert (r["nodes"], r["nodes_created"], r["edges_created"], r["reused"]) == (2, 1, 1, 1)


def test_lost_texts_are_stored_late_and_cuts_are_reported(spark):
    s = GraphStore(spark, scratch_path(spark, "docs"), "g")
    text = "\n\n".join(f"Point {x}" for x in ("Alpha", "Beta", "Gamma"))
    r = ingest(spark, s, [("u", text, 1)], max_chunks=2)
    assert r["truncated"] == 1 and r["nodes"] == 2
    for b in s.texts.batches():
        fs.delete(spark, f"{s.texts.root}/batch={b}")
    r = ingest(spark, s, [("u", text, 1)])
    assert (r["processed"], r["backfilled"]) == (0, 1) and rows(s.texts.current(), "text") == [(text,)]


def with_attrs(text):
    name, _, value = text.partition("=")
    return {"entities": [{"name": name, "label": "Gauge", "attrs": {"level": json.loads(value), "bad-key": 1}}], "relations": []}


def test_attributes_become_typed_columns(spark):
    s = GraphStore(spark, scratch_path(spark, "docs"), "g")
    ingest(spark, s, [("u", "Alpha=3\n\nBeta=true", 1)], extractor=with_attrs)
    ingest(spark, s, [("v", 'Gamma="12"\n\nDelta="x"', 1)], now="2025-01-02 00:00:00", extractor=with_attrs)
    g = state_graph(s)
    assert dict(g.nodes.dtypes)["level"] == "bigint" and "bad-key" not in g.nodes.columns
    assert rows(g.nodes, "NODE", "LABEL", "level") == [("Alpha", "Gauge", 3), ("Beta", "Gauge", 1), ("Delta", "Gauge", None), ("Gamma", "Gauge", 12)]
    assert rows(match(g, [N("n", "Gauge", F.col("level") > 2)]).select("n.NODE")) == [("Alpha",), ("Gamma",)]


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(x, "P", ["P"]) for x in nodes], "NODE string, LABEL string, labels array<string>")
    return PropertyGraph(n, spark.createDataFrame(edges, "ID string, src string, dst string, type string"))


def test_edges_that_share_an_id_are_different_edges(spark):
    g = graph(spark, "abc", [("1", "a", "b", "T"), ("1", "b", "c", "U"), (None, "c", "a", "T")])
    m = match(g, [N("x"), E("e"), N("y"), E("f"), N("z")])
    assert rows(m.select(*[F.col(f"{a}.NODE").alias(a) for a in "xyz"])) == [("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")]
    back = match(g, [N("x"), E("e", direction="-"), N("_m"), E("f", direction="-"), N("z")])
    assert back.filter("x.NODE = z.NODE").count() == 0  # never the same edge twice
    _, edges = result_subgraph(match(graph(spark, "azby", [("e1", "a", "z", "T1"), ("e1", "b", "y", "T2")]), [N("x"), E("e"), N("y")]))
    assert rows(edges) == [("e1", "a", "z", "T1"), ("e1", "b", "y", "T2")]


def test_lineage_of_qualified_names(spark):
    spec = {"tables": {"bay.vertexes": "", "bay.edges": "", "bay": "/x/bay.parquet"},
            "nodes": [{"sql": "SELECT * FROM bay.vertexes"}], "edges": [{"sql": "SELECT * FROM bay.edges"}]}
    root = scratch_path(spark, "recipes")
    store.record_recipe(spark, root, "w.g", "spark", "CREATE ...", "test", json.dumps({"tables": {}}), "2025-01-01 00:00:00")
    rec = store.record_recipe(spark, root, "w.g", "spark", "CREATE ...", "test", json.dumps(spec), "2025-01-02 00:00:00")
    assert rec.count() == 2
    got = dict(rows(source_lineage(rec).filter("graph = 'g'"), "name", "role"))
    assert got["bay.vertexes"] == "nodes" and got["bay.edges"] == "edges"
    from graphloom.operators.build import creation_ledger_latest
    assert creation_ledger_latest(rec).filter("ts = '2025-01-02'").count() == 1


def test_promoted_columns_are_stored(spark):
    root = scratch_path(spark, "store")
    g = graph(spark, "abc", [("1", "a", "b", "T")])
    store.write_graph(spark, g, root, "g")
    wide = spark.createDataFrame([("a", 5), ("b", None), ("z", 9)], "NODE string, depth int")
    for _ in range(2):
        stats = store.promote_into(spark, root, "g", wide).first()
        assert (stats["nodes_matched"], stats["properties_set"]) == (1, 1)
    assert rows(store.read_graph(spark, root, "g").nodes, "NODE", "depth") == [("a", 5), ("b", None), ("c", None)]
    # Interrupted between the delete and the rename.
    path = store.table_path(root, "g", "nodes")
    fs.rename(spark, path, path + "__new")
    assert store.read_graph(spark, root, "g").nodes.count() == 3


def test_unreadable_graphs_are_listed_with_zeros(spark):
    root = scratch_path(spark, "store")
    store.write_graph(spark, graph(spark, "ab", [("1", "a", "b", "T")]), root, "good")
    os.makedirs(f"{root}/broken_nodes")
    assert rows(store.stored_graph_sizes(spark, root)) == [("broken", 0, 0), ("good", 2, 1)]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from graphloom import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def big_graph(spark, n=20_000):
    nodes = spark.range(n).select(F.format_string("v%06d", F.col("id") * 7919 % n).alias("NODE"), F.lit("P").alias("LABEL"), F.array(F.lit("P")).alias("labels"))
    edges = spark.range(3 * n).select(F.format_string("e%06d", "id").alias("ID"), F.format_string("v%06d", F.col("id") * 31 % n).alias("src"),
                                      F.format_string("v%06d", F.col("id") * 17 % n).alias("dst"), F.when(F.col("id") % 3 == 0, "T").otherwise("U").alias("type"))
    return PropertyGraph(nodes, edges)


def test_stored_numbers_pages_and_capped_pulls(spark):
    from graphloom.operators import browse as BR
    root, plain = scratch_path(spark, "store"), big_graph(spark)
    store.write_graph(spark, plain, root, "g")
    g = store.read_graph(spark, root, "g")
    assert "src_idx" not in g.edges.columns
    for cap in (None, 0, 1, 4096, 5000, 10**6):
        n, e = BR.subgraph_capped_pairs(g, cap)
        n0, e0 = BR.subgraph_capped_pairs(plain, cap)
        assert rows(n, "NODE", "LABEL", "idx") == rows(n0, "NODE", "LABEL", "idx") and rows(e) == rows(e0), cap
    for offset in (0, 4095, 4096, 17_000, 19_990, 30_000):
        assert [r["NODE"] for r in BR.page_offset(g, offset, 50).collect()] == [f"v{i:06d}" for i in range(offset, min(offset + 50, 20_000))]
    a, b = BR.page_all(g, 700), BR.page_all(plain, 700)
    assert rows(a[0]) == rows(b[0]) and rows(a[1]) == rows(b[1])
    plan = BR.subgraph_capped_pairs(g, 5000)[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "LessThan(src_idx,5000)" in plan


def test_a_graph_replaces_itself(spark):
    root = scratch_path(spark, "store")
    store.write_graph(spark, graph(spark, "abc", [("1", "a", "b", "T"), ("2", "b", "zz", "T")]), root, "g")
    g = store.read_graph(spark, root, "g")
    store.write_graph(spark, PropertyGraph(g.nodes.filter("NODE <> 'c'"), g.edges), root, "g")
    again = store.read_graph(spark, root, "g")
    assert rows(again.nodes, "NODE") == [("a",), ("b",)] and again.edges.count() == 2


def test_a_crash_while_a_graph_is_replaced(spark):
    root = scratch_path(spark, "store")
    store.write_graph(spark, graph(spark, "abc", [("1", "a", "b", "T")]), root, "g")
    # A build that did not finish changes nothing.
    os.makedirs(f"{root}/.g.new/nodes")
    assert store.read_graph(spark, root, "g").nodes.count() == 3
    # One that finished, but whose tables were not all moved.
    store.write_graph(spark, graph(spark, "xy", [("9", "x", "y", "U")]), root, "h")
    os.makedirs(f"{root}/.g.ready")
    for kind in ("edges", "label_keys", "files", "fence", "nodes"):
        os.rename(f"{root}/h_{kind}", f"{root}/.g.ready/{kind}")
    fs.delete(spark, f"{root}/g_nodes")
    assert store.list_graphs(spark, root) == ["g"]
    g = store.read_graph(spark, root, "g")
    assert rows(g.nodes, "NODE") == [("x",), ("y",)] and rows(g.edges, "ID") == [("9",)] and not os.path.exists(f"{root}/.g.ready")
