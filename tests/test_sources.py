"""Sources: scans by extension, catalog registration, append import, text
documents, graph store and streams."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.sources import files as S
from graphloom.sources import store
from tests.conftest import SF_SMALL, rows


def test_scan_formats_and_register(spark):
    d = tempfile.mkdtemp(prefix="gl-src-")
    nat = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    nat.write.option("header", True).option("sep", "\t").csv(os.path.join(d, "nation.tsv"))
    nat.write.option("header", True).csv(os.path.join(d, "nation.csv"))
    assert S.scan(spark, os.path.join(d, "nation.tsv")).count() == 25
    S.register_tables(spark, {"glsrc.nation_csv": os.path.join(d, "nation.csv"),
                              "glsrc.nation_pq": f"{SF_SMALL}/nation.parquet", "nation_v": "nation"},
                      data_dir=SF_SMALL)
    assert spark.sql("SELECT COUNT(*) FROM glsrc.nation_csv").first()[0] == 25
    assert spark.sql("SELECT COUNT(*) FROM glsrc.nation_pq").first()[0] == 25
    assert spark.sql("SELECT COUNT(*) FROM nation_v").first()[0] == 25
    with pytest.raises(ValueError):
        S.register_tables(spark, {"bad name!": f"{SF_SMALL}/nation.parquet"})


def test_load_table_appends(spark):
    root = tempfile.mkdtemp(prefix="gl-tables-")
    S.load_table(spark, f"{SF_SMALL}/region.parquet", root=root)
    t = S.load_table(spark, f"{SF_SMALL}/region.parquet", root=root)
    assert t.count() == 10 and os.path.isdir(os.path.join(root, "region"))


def test_read_text_documents(spark):
    d = tempfile.mkdtemp(prefix="gl-docs-")
    with open(os.path.join(d, "a.txt"), "wb") as f:
        f.write("héllo\n\nworld".encode("utf-8"))
    with open(os.path.join(d, "b.md"), "wb") as f:
        f.write(b"bad \xff byte")
    docs = S.read_text_documents(spark, d)
    got = {os.path.basename(r["doc_uri"]): r["text"] for r in docs.collect()}
    assert got["a.txt"] == "héllo\n\nworld" and got["b.md"].startswith("bad ")
    with open(os.path.join(d, "c.pdf"), "wb") as f:
        f.write(b"%PDF")
    with pytest.raises(ValueError):
        S.read_text_documents(spark, d)


def test_store_round_trip_and_delete(spark):
    root = tempfile.mkdtemp(prefix="gl-store-")
    n = spark.createDataFrame([("a", "X", ["X"]), ("b", "Y", ["Y"])], "NODE string, LABEL string, labels array<string>")
    e = spark.createDataFrame([("e", "a", "b", "R")], "ID string, src string, dst string, type string")
    store.write_graph(spark, PropertyGraph(n, e), root, "db.g1")
    store.write_graph(spark, PropertyGraph(n, e), root, "g2")
    assert sorted(store.list_graphs(spark, root)) == ["g1", "g2"]
    meta = {"ledger": spark.createDataFrame([("g1", "u"), ("g2", "v")], "graph string, doc_uri string")}
    left = store.delete_graph(spark, root, "db.g1", metadata=meta)
    store.delete_graph(spark, root, "db.g1")
    assert store.list_graphs(spark, root) == ["g2"]
    assert rows(left["ledger"], "graph") == [("g2",)]
    assert rows(store.stored_graph_sizes(spark, root)) == [("g2", 2, 1)]


def test_stream_tables_pending_and_drop(spark):
    from graphloom.streaming import ingest_stream as ST
    base = tempfile.mkdtemp(prefix="gl-stream-")
    cols = "kind string, id string, label string, src string, dst string, _ord long"
    # File 1 holds the edge, file 2 its endpoints.
    spark.createDataFrame([("edge", "e1", "R", "a", "b", 1)], cols).write.parquet(base + "/in/f1")
    spark.createDataFrame([("node", "a", "X", None, None, 2), ("node", "b", "X", None, None, 3)], cols) \
        .write.parquet(base + "/in/f2")
    src = base + "/in/*"
    n, e, p = ST.stream_tables(spark, src, cols, base + "/keep", base + "/ck1")
    assert n.count() == 2 and rows(e.select("ID")) == [("e1",)] and p.count() == 0
    n, e, p = ST.stream_tables(spark, src, cols, base + "/drop", base + "/ck2", retry_pending=False)
    assert n.count() == 2 and e.count() == 0


def test_edges_of_known_types_are_written_where_they_are_made(spark):
    """A folder per type without a shuffle or a sort, the same rows as the general form."""
    from graphloom.session import scratch_path
    e = spark.range(90).select(F.concat(F.lit("e"), "id").alias("ID"), F.lit("a").alias("src"), F.lit("b").alias("dst"),
                               F.when(F.col("id") % 3 == 0, "T").otherwise("U").alias("type"), F.col("id").alias("w"))
    a, b, c = (scratch_path(spark, "edges") for _ in range(3))
    store._write_edges(e, a, ["T", "U", "T"])
    store._write_edges(e, b)
    store._write_edges(e.withColumn("type", F.lit("a/b")), c, ["a/b"])
    assert sorted(n for n in os.listdir(a) if n.startswith("type=")) == ["type=T", "type=U"]
    assert rows(store._edges(spark, a), "ID", "type", "w") == rows(store._edges(spark, b), "ID", "type", "w") == rows(e, "ID", "type", "w")
    assert rows(store._edges(spark, c).select("type").distinct()) == [("a/b",)]
