"""Queries: document ingest end to end (I16) and the streaming forms (L1-L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.doc_ingest import GraphStore, ingest_documents, state_graph
from ..operators.match import E, N, match
from ..session import scratch_path
from ..streaming import ingest_stream as ST
from .q_docs import conversation_docs, ents_sql
from .registry import query
from .tpch import tpch_graph, with_graph

#: Rows of an arriving file, at most: a micro-batch reads a file with one task.
FILE_ROWS = 1_000_000


def _arrive(rows, path: str, *by) -> int:
    """Write ``rows`` (dealt by ``by``) as at least 4 arriving files; returns
    the files of a trigger that make four micro-batches."""
    files = max(4, -(-rows.count() // FILE_ROWS))
    rows.repartition(files, *by).write.mode("overwrite").parquet(path)
    return -(-files // 4)


EXTRA_PARAGRAPH = "New Paragraph Here and Another One"


def _conv_batch(spark, sf, changed: bool):
    d = conversation_docs(spark, sf)
    text = F.col("text")
    if changed:
        text = F.when(F.col("doc_id") % 10 == 0,
                      F.concat(F.col("text"), F.lit("\n\n" + EXTRA_PARAGRAPH))).otherwise(F.col("text"))
    return d.select(F.concat(F.lit("conv:"), F.col("doc_id")).alias("doc_uri"), text.alias("text"),
                    F.col("doc_id").alias("ord"))


INGEST_SQL = "WITH " + ents_sql() + f""",
chg AS (SELECT EXISTS (SELECT 1 FROM docs WHERE doc_id % 10 = 0) AS any_chg)
SELECT 1 AS run, (SELECT COUNT(*) FROM docs) AS documents, (SELECT COUNT(*) FROM docs) AS processed,
       (SELECT COUNT(DISTINCT NODE) FROM merged) AS nodes_created, (SELECT COUNT(DISTINCT id) FROM mrels) AS edges_created
UNION ALL
SELECT 2, (SELECT COUNT(*) FROM docs), (SELECT COUNT(*) FROM docs WHERE doc_id % 10 = 0),
       CASE WHEN (SELECT any_chg FROM chg) THEN (SELECT COUNT(*) FROM (VALUES ('New Paragraph Here'), ('Another One')) v(n)
                                                  WHERE n NOT IN (SELECT NODE FROM merged)) ELSE 0 END,
       CASE WHEN (SELECT any_chg FROM chg) AND left(sha1('New Paragraph Here|Another One|NEXT_TO'), 16)
                 NOT IN (SELECT id FROM mrels) THEN 1 ELSE 0 END
"""


@query("document_ingest", INGEST_SQL)
def q_document_ingest(spark, sf):
    """I16: two ingest runs of the conversation documents; in run 2 every
    tenth document gained a paragraph, the others are skipped by the ledger."""
    store = GraphStore(spark, scratch_path(spark, "docgraph"), "warehouse.conversations")
    r1 = ingest_documents(spark, store, _conv_batch(spark, sf, False), "2025-01-01 00:00:00")
    r2 = ingest_documents(spark, store, _conv_batch(spark, sf, True), "2025-01-02 00:00:00")
    # Each report reads the batches of its own run.
    cols = ["run", "documents", "processed", "nodes_created", "edges_created"]
    return (r1.withColumn("run", F.lit(1)).select(*cols)
            .unionByName(r2.withColumn("run", F.lit(2)).select(*cols)))


@query("stream_extract", "WITH " + ents_sql() + """
SELECT DISTINCT 'node' AS kind, NODE AS id FROM merged
UNION ALL SELECT DISTINCT 'edge', id FROM mrels
""")
def q_stream_extract(spark, sf):
    """L1: the conversation documents arrive as 4 files; each micro-batch is
    ingested; the final graph equals the batch result."""
    base = scratch_path(spark, "stream-docs")
    src = base + "/in"
    _conv_batch(spark, sf, False).repartition(4, "doc_uri").write.mode("overwrite").parquet(src)
    store = GraphStore(spark, base + "/store", "conversations")
    ST.stream_extract(spark, src, "doc_uri string, text string, ord long", store, base + "/ckpt",
                      max_files_per_trigger=2)
    n = store.nodes.current().select(F.lit("node").alias("kind"), F.col("NODE").alias("id"))
    e = store.edges.current().select(F.lit("edge").alias("kind"), F.col("ID").alias("id"))
    return n.unionByName(e)


@query("stream_tables", """
SELECT 'node' AS kind, 'c:' || c_custkey AS id FROM customer
UNION ALL SELECT 'node', 'o:' || o_orderkey FROM orders
UNION ALL SELECT 'edge', 'pl:' || o_orderkey FROM orders
""")
def q_stream_tables(spark, sf):
    """L2: customer/order node rows and PLACED edge rows arrive mixed, as four
    micro-batches (edges may come before their endpoints -> pending, retried)."""
    from .tpch import read
    base = scratch_path(spark, "stream-tables")
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    cols = "kind string, id string, label string, src string, dst string, _ord long"
    nulls = lambda: (F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = (c.select(F.lit("node").alias("kind"), F.concat(F.lit("c:"), "c_custkey").alias("id"),
                     F.lit("customer").alias("label"), *[x.alias(n) for x, n in zip(nulls(), ["src", "dst"])],
                     F.col("c_custkey").alias("_ord"))
            .unionByName(o.select(F.lit("node").alias("kind"), F.concat(F.lit("o:"), "o_orderkey").alias("id"),
                                  F.lit("orders").alias("label"), *[x.alias(n) for x, n in zip(nulls(), ["src", "dst"])],
                                  F.col("o_orderkey").alias("_ord")))
            .unionByName(o.select(F.lit("edge").alias("kind"), F.concat(F.lit("pl:"), "o_orderkey").alias("id"),
                                  F.lit("PLACED").alias("label"), F.concat(F.lit("c:"), "o_custkey").alias("src"),
                                  F.concat(F.lit("o:"), "o_orderkey").alias("dst"), F.col("o_orderkey").alias("_ord"))))
    src = base + "/in"
    files = _arrive(rows, src, F.xxhash64("id"))
    nodes, edges, _ = ST.stream_tables(spark, src, cols, base + "/state", base + "/ckpt", max_files_per_trigger=files)
    return (nodes.select(F.lit("node").alias("kind"), F.col("NODE").alias("id"))
            .unionByName(edges.select(F.lit("edge").alias("kind"), F.col("ID").alias("id"))))


@query("stream_schema_counts", with_graph("""
SELECT LABEL AS label, COUNT(*) AS n FROM nodes GROUP BY LABEL
"""))
def q_stream_schema_counts(spark, sf):
    """L3: graph node rows arrive as files, some of them twice; the counts
    equal the batch F3 counts."""
    base = scratch_path(spark, "stream-counts")
    src = base + "/in"
    n = tpch_graph(spark, sf).nodes.select("NODE", "LABEL")
    again = n.filter(F.crc32("NODE") % 4 == 0)
    files = _arrive(n.unionByName(again), src)
    return ST.stream_schema_counts(spark, src, "NODE string, LABEL string", base + "/state", base + "/ckpt", max_files_per_trigger=files)


@query("ingest_then_match", "WITH " + ents_sql() + """,
node AS (SELECT DISTINCT NODE, CASE WHEN len(string_split(NODE, ' ')) = 1 THEN 'Term' ELSE 'Name' END AS LABEL FROM merged),
edge AS (SELECT DISTINCT src, dst, label, id FROM mrels)
SELECT a.LABEL AS src_label, b.LABEL AS dst_label, COUNT(*) AS n, COUNT(DISTINCT e.src) AS sources
FROM edge e JOIN node a ON a.NODE = e.src JOIN node b ON b.NODE = e.dst GROUP BY a.LABEL, b.LABEL
""")
def q_ingest_then_match(spark, sf):
    """Conversations are ingested (in two batches), and the state is matched
    as a property graph."""
    store = GraphStore(spark, scratch_path(spark, "docgraph"), "conversations")
    batch = _conv_batch(spark, sf, False)
    first = F.crc32(F.col("doc_uri")) % 2 == 0
    ingest_documents(spark, store, batch.filter(first), "2025-01-01 00:00:00")
    ingest_documents(spark, store, batch.filter(~first), "2025-01-02 00:00:00")
    m = match(state_graph(store), [N("a"), E("e", type="NEXT_TO"), N("b")])
    return (m.groupBy(F.col("a.LABEL").alias("src_label"), F.col("b.LABEL").alias("dst_label"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a.NODE").alias("sources")))
