"""Plan checks: no registered query plans a cartesian product or a nested
loop join, and a match on the stored graph prunes edge partitions and
columns."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, rows

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: These run whole ingests and streams before they return a plan.
RUNNING = ("document_ingest", "ingest_then_match", "stream_extract", "stream_tables", "stream_schema_counts")


def _keys():
    from graphloom.plans import queries
    return sorted(k for k in queries() if k not in RUNNING)


@pytest.mark.parametrize("key", _keys())
def test_no_nested_loops(spark, key):
    import __spark_entry__ as E
    df = E.queries()[key](spark, SF_SMALL)
    plan = _plan(df)
    assert not any(b in plan for b in BAD), plan


def test_match_on_store_prunes(spark):
    from graphloom.operators.match import E, N, match
    from graphloom.plans.tpch import edge_specs, node_specs
    from graphloom.sources import store
    root = tempfile.mkdtemp(prefix="gl-store-")
    g = store.build_and_store(spark, node_specs(spark, SF_SMALL), edge_specs(spark, SF_SMALL), root, "tpch")
    m = match(g, [N("c", "customer"), E(type="PLACED"), N("o", "orders", props=["o_totalprice"])])
    plan = _plan(m.select(F.col("o.o_totalprice")))
    assert "PartitionFilters: [isnotnull(type" in plan and "PLACED" in plan
    assert "ReadSchema: struct<src:string,dst:string>" in plan


def _final(df):
    df.collect()
    return _plan(df)


def test_hydration_is_lazy_prunes_and_splits_hot_keys(spark):
    """Filters above a hydration reach the scan; a key with a third of all
    rows is split although the wide side comes out of an aggregation."""
    from graphloom.operators.hydrate import hydrate
    from graphloom.session import scratch_path
    path = scratch_path(spark, "hot")
    n = 600_000
    (spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("k0")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("NODE"),
                           F.col("id").alias("v"), F.rpad(F.col("id").cast("string"), 60, "x").alias("pad")).write.parquet(path))
    res = spark.read.parquet(path)
    wide = res.select("NODE", F.col("v").alias("w"), "pad").withColumnRenamed("pad", "wpad")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = hydrate(res, wide)
        filtered = _plan(df.filter("v > 5").select("w"))
        assert "PushedFilters: [IsNotNull(NODE), IsNotNull(v), GreaterThan(v,5)]" in filtered.replace("IsNotNull(v), IsNotNull(NODE)", "IsNotNull(NODE), IsNotNull(v)")
        assert "pad" not in filtered.split("ReadSchema")[1].split("\n")[0]
        out = df.agg(F.max("pad"), F.max("w"), F.count("v"))
        assert "skew=true" in _final(out)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_match_scans_the_stored_graph_once(spark):
    """A three-hop match scans each edge type and each labelled node once; nothing is rebuilt."""
    import __spark_entry__ as E
    df = E.queries()["match_path"](spark, SF_SMALL)
    plan = _plan(df)
    assert plan.count("tpch-") == plan.count("Scan parquet") == 7, plan  # four nodes, three edge types


def _stored(spark):
    from graphloom.graph import PropertyGraph
    from graphloom.session import scratch_path
    from graphloom.sources import store
    root = scratch_path(spark, "store")
    n = spark.range(4000).select(F.concat(F.lit("v"), F.col("id")).alias("NODE"), F.when(F.col("id") % 100 == 0, "Rare").otherwise("Common").alias("LABEL"), F.col("id").alias("x"))
    n = n.withColumn("labels", F.array("LABEL"))
    e = spark.range(9000).select(F.concat(F.lit("e"), F.col("id")).alias("ID"), F.concat(F.lit("v"), F.col("id") * 7 % 4000).alias("src"),
                                 F.concat(F.lit("v"), (F.col("id") * 3 + 1) % 4000).alias("dst"), F.when(F.floor(F.col("id") / 2) % 2 == 0, "T").otherwise("U").alias("type"))
    store.write_graph(spark, PropertyGraph(n, e), root, "g")
    return store, root


def test_bucketed_hops_and_hydration_have_no_exchange(spark):
    from graphloom.operators.hydrate import hydrate
    from graphloom.operators.match import E, N, match
    store, root = _stored(spark)
    wide = spark.range(4000).select(F.concat(F.lit("v"), F.col("id")).alias("NODE"), (F.col("id") * 2).alias("w"))
    store.write_bucketed(spark, root, "g", 4, wide=wide)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = store.read_graph(spark, root, "g")
        spark.sql("DROP TABLE gl_g_by_src")        # as in a session that did not write it
        g, w = store.read_bucketed(spark, root, "g", 4)
        for direction in ("->", "<-"):
            pattern = [N("a", "Common"), E("e", type="T", direction=direction), N("_b")]
            got = match(g, pattern, start=0)
            assert rows(got.select("a.NODE", "e.ID")) == rows(match(plain, pattern).select("a.NODE", "e.ID"))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        j = g.nodes.select("NODE", "x").join(w, "NODE")
        assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString()
        two = match(g, [N("a", "Rare"), E(type="T"), N("b", "Common")], start=0)
        assert two._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1     # the rows that move to the far node
        assert hydrate(got.select("a.NODE"), w, "NODE").count() == got.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))


def test_statistics_choose_the_start(spark):
    from graphloom.operators.match import E, N, choose_start, match
    store, root = _stored(spark)
    g = store.read_graph(spark, root, "g")
    assert g.meta["stats"]["labels"] == {"Rare": 40, "Common": 3960} and g.meta["stats"]["nodes"] == 4000
    assert g.meta["stats"]["types"]["T"][0] == 4500
    left = [N("r", "Rare"), E("e", type="T"), N("c", "Common"), E("f", type="U"), N("d", "Common")]
    right = [N("d", "Common"), E("f", type="U", direction="<-"), N("c", "Common"), E("e", type="T", direction="<-"), N("r", "Rare")]
    assert choose_start(g, left) == 0 and choose_start(g, right) == 2
    assert choose_start(g, [N("a", "Common"), E(), N("b", "Common", F.col("x") == 7), E(), N("c", "Common")]) == 1
    cols = ["r.NODE", "e.ID", "c.NODE", "f.ID", "d.NODE"]
    a, b = match(g, left), match(g, right)
    flat = lambda df: sorted(tuple(r) for r in df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]).collect())
    assert flat(a) == flat(b) == flat(match(g, right, start=0)) and flat(a)
    # The chain begins at the rare nodes: theirs is the innermost scan of the plan.
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    deepest = max((x for x in plan.split("\n") if "array_contains" in x), key=lambda x: len(x) - len(x.lstrip(" :")))
    assert "Rare" in deepest


def test_stream_state_joins_do_not_broadcast_ids(spark):
    from graphloom.operators import ingest as I
    from graphloom.session import scratch_path
    from graphloom.streaming import ingest_stream as ST
    root = scratch_path(spark, "state")
    nodes, edges = I.node_log(spark, f"{root}/nodes"), I.edge_log(spark, f"{root}/edges")
    nb = spark.range(50).select(F.concat(F.lit("v"), "id").alias("id"), F.lit("L").alias("label"), F.create_map().cast("map<string,string>").alias("attrs"), F.col("id").alias("_ord"))
    eb = nb.select(F.concat(F.lit("e"), "_ord").alias("id"), F.col("id").alias("src"), F.lit("v0").alias("dst"), "label", "attrs", "_ord")
    nodes.append(I.node_rows(nb, "2025-01-01 00:00:00", "1", seq=F.col("_ord")), "1")
    edges.append(I.edge_rows(eb, "2025-01-01 00:00:00", "1", seq=F.col("_ord"), nodes=None), "1")
    ready, _ = ST.settled(edges, nodes)
    assert _plan(ready).count("SortMergeJoin") == 2 and ready.count() == 50      # one per end


def test_arriving_files_are_bounded_in_rows(spark, monkeypatch):
    """More rows are more files of a micro-batch, not longer ones."""
    import glob

    from graphloom.plans import q_stream as Q
    from graphloom.session import scratch_path
    monkeypatch.setattr(Q, "FILE_ROWS", 100)
    for n, files, trigger in ((40, 4, 1), (1000, 10, 3)):
        path = scratch_path(spark, "arrive")
        assert Q._arrive(spark.range(n), path) == trigger
        assert len(glob.glob(f"{path}/*.parquet")) == files and spark.read.parquet(path).count() == n


def test_nodes_are_not_broadcast(spark):
    """Two columns of a node table look small to the planner, whatever the number of nodes."""
    from graphloom.operators.ontology import schema_by_axis
    store, root = _stored(spark)
    plan = _plan(schema_by_axis(store.read_graph(spark, root, "g")))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_linked_elements_are_extracted_once(spark):
    from graphloom.plans import queries
    plan = queries()["redirect_relations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "documents.parquet" not in plan
