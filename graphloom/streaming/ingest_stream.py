"""Structured Streaming forms of the incremental operators.

A graph that grows by repeated calls is a stream here. Each micro-batch is
appended to the state's logs inside ``foreachBatch`` under the id of its
epoch, so a replay writes over its own first try, and a micro-batch costs what
it brings, whatever the state's size: what needs the whole state (do an edge's
ends exist, the last label of a node) is worked out when the state is read.
``availableNow`` drains what is there and stops, which is also how the tests
drive them.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..functions.frames import splittable_join
from ..operators.batch_log import BatchLog, keyed
from ..operators.doc_ingest import GraphStore, ingest_documents


def _now() -> str:
    """The time of the batch, in UTC."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def _batch_id(epoch: int, checkpoint: str) -> str:
    """The same for every try of a micro-batch; another for another stream."""
    return f"{epoch:020d}-{hashlib.sha256(checkpoint.encode()).hexdigest()[:8]}"


def stream_extract(spark: SparkSession, source_dir: str, schema: str, store: GraphStore,
                   checkpoint: str, max_files_per_trigger: int = 1, clock=_now, **ingest_kw):
    """L1: documents (doc_uri, text, ord) arriving as Parquet files -> the
    document ingest of I16 per micro-batch."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))

    def each(batch: DataFrame, epoch: int) -> None:
        # The ingest writes its tables itself; the report is not needed.
        ingest_documents(batch.sparkSession, store, batch, clock(), uri=f"epoch:{epoch}", batch_id=_batch_id(epoch, checkpoint), **ingest_kw)

    q = (src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return store


def stream_tables(spark: SparkSession, source_dir: str, schema: str, root: str, checkpoint: str,
                  max_files_per_trigger: int = 1, retry_pending: bool = True, clock=_now):
    """L2: node/edge rows arriving as files -> node rows (C1) and edge rows
    (C2) appended per micro-batch; returns (nodes, edges, pending).

    Edges are kept whether or not their ends are there yet: an edge is in
    ``edges`` once both ends are nodes (seen first when the last of the three
    came), and in ``pending`` with the time of its first try until then;
    :func:`overdue` reports the ones that wait for long. With
    ``retry_pending=False`` an edge whose ends are missing in its own
    micro-batch is dropped; only then node ids are read per batch.

    Input columns: kind ('node'|'edge'), id, label, src, dst, _ord and, if
    there are attributes, attrs (map<string,string> of JSON texts)."""
    nodes, edges = I.node_log(spark, f"{root}/nodes"), I.edge_log(spark, f"{root}/edges")
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    attrs = F.col("attrs") if "attrs" in src.columns else F.create_map().cast("map<string,string>")

    def each(batch: DataFrame, epoch: int) -> None:
        now, at = clock(), _batch_id(epoch, checkpoint)
        nb = batch.filter(F.col("kind") == "node").select("id", "label", attrs.alias("attrs"), "_ord")
        eb = batch.filter(F.col("kind") == "edge").select("id", "src", "dst", "label", attrs.alias("attrs"), "_ord")
        nodes.append(I.node_rows(nb, now, at, seq=F.col("_ord")), at)
        known = None if retry_pending else nodes.rows().select("NODE").distinct()
        edges.append(I.edge_rows(eb, now, at, seq=F.col("_ord"), nodes=known), at)

    q = (src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    ready, pending = settled(edges, nodes)
    return nodes.current(), ready, pending


def settled(edges: BatchLog, nodes: BatchLog) -> tuple[DataFrame, DataFrame]:
    """The edges whose ends are nodes, and the ones that wait
    (``waiting_since``), from the logs. The ids of the nodes are aggregated
    once per end; the joins' shuffles may be split (a hub ends many edges).
    The ids are never broadcast: to the planner two columns of a well packed
    log look small, and the driver would hold a row for every node."""
    seen = nodes.rows().groupBy("NODE").agg(F.min("first_seen_ts").alias("t")).hint("merge")
    e = edges.current()
    for end in ("src", "dst"):
        e = splittable_join(e, seen.select(F.col("NODE").alias(end), F.col("t").alias(f"_{end}")), [end], "left")
    there = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    first = F.greatest("first_seen_ts", "_src", "_dst").alias("first_seen_ts")
    ready = e.filter(there).select("ID", "src", "dst", "type", "attrs", first, F.greatest("last_seen_ts", "_src", "_dst").alias("last_seen_ts"))
    wait = e.filter(~there).select(F.col("ID").alias("id"), "src", "dst", F.col("type").alias("label"), "attrs", F.col("first_seen_ts").alias("waiting_since"))
    return ready, wait


def overdue(pending: DataFrame, now: str, seconds: int) -> DataFrame:
    """Pending edges that wait for more than ``seconds``: a report, they stay pending."""
    age = F.lit(now).cast("timestamp").cast("long") - F.col("waiting_since").cast("long")
    return pending.withColumn("waiting_sec", age).filter(F.col("waiting_sec") > seconds)


def stream_schema_counts(spark: SparkSession, source_dir: str, schema: str, root: str, checkpoint: str,
                         max_files_per_trigger: int = 1) -> DataFrame:
    """L3: label counts (F3 form) over node rows (NODE, LABEL) arriving as
    files. A node sent again counts once, with its last label: that of the
    last micro-batch, and in it of the last row (by ``_ord`` where the rows
    have it, else by file time, file name and place in the file)."""
    seen = keyed(spark, f"{root}/seen", "NODE string, LABEL string", ["NODE"])
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    place = ["_ord"] if "_ord" in src.columns else ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index"]
    src = src.select("NODE", "LABEL", F.struct(*place).alias("_place"))

    def each(batch: DataFrame, epoch: int) -> None:
        last = batch.filter("NODE is not null").groupBy("NODE").agg(F.max_by("LABEL", "_place").alias("LABEL"))
        seen.append(last, _batch_id(epoch, checkpoint))

    q = (src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return seen.current().groupBy(F.col("LABEL").alias("label")).agg(F.count(F.lit(1)).alias("n"))
