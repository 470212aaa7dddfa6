"""Approximate distinct counts that are kept with the state.

Each batch appends one HyperLogLog sketch per group (label, type, ...) of the
ids that it brought; a union of sketches is the sketch of the union, whatever
comes twice, so the log's merge is a union and a replay or a compaction changes
no estimate. Reading the counts costs a row per group and batch, not the ids.
Exact counts (:mod:`graphloom.operators.ontology`) stay the default; the
relative error is about 1.04 / sqrt(2 ** lg_k) (one standard deviation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batch_log import BatchLog

LG_K = 12


def sketch_rows(rows: DataFrame, group: str, value: str, lg_k: int = LG_K) -> DataFrame:
    """One row per group: ``name`` and the ``sketch`` of its distinct values
    (null values count nothing; a null group is a group). Partial sketches are
    made before the shuffle, so a hot group moves a sketch per task."""
    return rows.groupBy(F.col(f"`{group}`").cast("string").alias("name")).agg(F.hll_sketch_agg(f"`{value}`", F.lit(lg_k)).alias("sketch"))


def _merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.hll_union_agg("sketch").alias("sketch"), F.max("seq").alias("seq"))


def _estimates(merged: DataFrame) -> DataFrame:
    return merged.select("name", F.hll_sketch_estimate("sketch").alias("n"))


def sketch_log(spark: SparkSession, root: str) -> BatchLog:
    """The log of one grouped count: ``append(sketch_rows(...), batch)``;
    ``current()`` gives (name, n)."""
    return BatchLog(spark, root, "name string, sketch binary, seq string", _merge, _estimates)


def total(log: BatchLog) -> DataFrame:
    """One row: the distinct values over all groups (n; 0 for an empty log)."""
    return log.rows().agg(F.hll_union_agg("sketch").alias("s")).select(F.coalesce(F.hll_sketch_estimate("s"), F.lit(0).cast("long")).alias("n"))
