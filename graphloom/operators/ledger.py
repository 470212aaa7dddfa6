"""Document ledger and text store.

Ledger: ``graph, doc_uri, sha256, source_type, first_ingested_ts,
last_ingested_ts, status`` (PK graph, doc_uri). Text store: ``graph, doc_uri,
text, char_len``. Upserts are one full outer join per batch; statuses of
repeated submissions of one uri inside a batch follow their order through a
window partitioned by (graph, uri) — a bounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import fingerprint, graph_key, text_key, text_uri

LEDGER_SCHEMA = ("graph string, doc_uri string, sha256 string, source_type string, "
                 "first_ingested_ts timestamp, last_ingested_ts timestamp, status string")
TEXT_SCHEMA = "graph string, doc_uri string, text string, char_len bigint"
RECIPE_SCHEMA = "graph string, engine string, statement string, source string, ts timestamp, spec_json string"


def document_fingerprint(docs: DataFrame, text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """sha256 of the UTF-8 text; ``doc_uri`` (the key) = file name if
    given, else ``text:<sha>``; ``display_uri`` has the short ``text:<sha[:12]>``."""
    sha = fingerprint(F.col(text_col))
    uri, short = text_key(sha), text_uri(sha)
    if name_col is not None:
        uri, short = F.coalesce(F.col(name_col), uri), F.coalesce(F.col(name_col), short)
    return docs.withColumn("sha256", sha).withColumn("doc_uri", uri).withColumn("display_uri", short)


def ledger_upsert(ledger: DataFrame, batch: DataFrame, now, source_type: str = "text"):
    """Batch rows (graph, doc_uri, sha256, ord) -> (per-row statuses,
    new ledger). Status: new (uri unknown), unchanged (same sha as the
    previous submission), updated (different sha). first_ingested_ts is
    kept; sha, last_ingested_ts and status follow the last submission. The
    graph key is the last dotted part of the graph name."""
    nowc = F.lit(now).cast("timestamp")
    b = batch.withColumn("graph", graph_key(F.col("graph")))
    old = ledger.select("graph", "doc_uri", F.col("sha256").alias("_old_sha"),
                        F.col("first_ingested_ts").alias("_old_first"))
    j = b.join(old, ["graph", "doc_uri"], "left")
    w = Window.partitionBy("graph", "doc_uri").orderBy("ord")
    prev = F.coalesce(F.lag("sha256").over(w), F.col("_old_sha"))
    seen = F.lag("sha256").over(w).isNotNull() | F.col("_old_sha").isNotNull()
    rows = j.withColumn("status", F.when(~seen, "new").when(prev == F.col("sha256"), "unchanged")
                        .otherwise("updated"))
    last = rows.groupBy("graph", "doc_uri").agg(
        F.max_by(F.struct("sha256", "status"), "ord").alias("x"), F.first("_old_first").alias("_old_first"))
    upd = last.select("graph", "doc_uri", "x.sha256", F.lit(source_type).alias("source_type"),
                      F.coalesce("_old_first", nowc).alias("first_ingested_ts"),
                      nowc.alias("last_ingested_ts"), "x.status")
    keep = ledger.join(upd.select("graph", "doc_uri"), ["graph", "doc_uri"], "left_anti")
    return rows.select(*batch.columns, "status"), keep.unionByName(upd)


def skip_unchanged(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch documents to (re)process: (graph, uri, sha) not in the
    ledger. The ledger must be written only AFTER the graph ingest succeeded,
    so a failed run is retried."""
    b = batch.withColumn("_g", graph_key(F.col("graph")))
    led = ledger.select(F.col("graph").alias("_g"), "doc_uri", "sha256")
    return b.join(led, ["_g", "doc_uri", "sha256"], "left_anti").drop("_g")


def list_documents(ledger: DataFrame, graph: str, doc_uri: str | None = None) -> DataFrame:
    """Ledger rows of a graph (or one lookup)."""
    out = ledger.filter(F.col("graph") == graph.rsplit(".", 1)[-1])
    if doc_uri is not None:
        out = out.filter(F.col("doc_uri") == doc_uri)
    return out


def record_text(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Text store upsert: one text per (graph, uri), the last submission's
    (by ``ord`` where the batch has it, else the greatest text)."""
    order = F.struct(F.col("ord"), F.col("text")) if "ord" in batch.columns else F.col("text")
    b = (batch.select(graph_key(F.col("graph")).alias("graph"), "doc_uri", "text", order.alias("_o"))
         .groupBy("graph", "doc_uri").agg(F.max_by("text", "_o").alias("text"))
         .withColumn("char_len", F.length("text").cast("long")))
    keep = store.join(b.select("graph", "doc_uri"), ["graph", "doc_uri"], "left_anti")
    return keep.unionByName(b)


def document_text(store: DataFrame, graph: str, limit: int | None = None) -> DataFrame:
    """Stored text sliced to ``limit`` chars, with char_len and
    ``truncated`` (char_len > length of the slice)."""
    s = store.filter(F.col("graph") == graph.rsplit(".", 1)[-1])
    txt = F.col("text") if limit is None else F.substring("text", 1, limit)
    return s.select("doc_uri", txt.alias("text"), "char_len",
                    (F.col("char_len") > F.length(txt)).alias("truncated"))


def backfill_text(store: DataFrame, statuses: DataFrame) -> DataFrame:
    """Re-submitted unchanged documents missing from the text store
    get their text (rows to append)."""
    s = statuses.filter(F.col("status") == "unchanged").withColumn("graph", graph_key(F.col("graph")))
    return s.join(store.select("graph", "doc_uri"), ["graph", "doc_uri"], "left_anti")


def clear_metadata(tables: dict, graph: str) -> dict:
    """Drop one graph's rows from every metadata table (ledger,
    ontology, recipes, texts); idempotent."""
    key = graph.rsplit(".", 1)[-1]
    return {name: df.filter(F.col("graph") != key) for name, df in tables.items()}
