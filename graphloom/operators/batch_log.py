"""Incremental state as appended batches.

A table is a folder of Parquet batches, ``batch=<id>``; a batch is written
once, and written over by its own replay. The state is an aggregation of all
rows by key, made when it is read. Every merge used here is associative,
commutative and idempotent (smallest, largest, the value with the largest
``seq``, set union), so the order in which writers finish, a batch that is
there twice, or a compaction that a crash left half done change nothing.
There are no manifests and no locks: two writers append two batches.

``seq`` is the id of the batch that brought a value; ids sort as text in the
order of the batches. Compaction is an ordinary job: it writes the merged
rows, each value with its own ``seq``, as one batch, and only then deletes
the batches that it read.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fs


def new_batch_id() -> str:
    """An id of its own that sorts by time."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


class BatchLog:
    """``schema``: columns of a stored row, ``seq`` among them; ``merge``:
    stored rows -> one stored row per key; ``state``: merged rows -> what
    readers see."""

    def __init__(self, spark: SparkSession, root: str, schema: str, merge: Callable[[DataFrame], DataFrame],
                 state: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.merge, self.state = merge, state

    def batches(self) -> list[str]:
        return [n.split("=", 1)[1] for n in fs.list_names(self.spark, self.root) if n.startswith("batch=")]

    def _path(self, batch: str) -> str:
        return os.path.join(self.root, f"batch={batch}")

    def rows(self, skip: str | None = None) -> DataFrame:
        """The stored rows of all batches that are there now. ``skip``: the
        batch that is being written; a replay must not see its first try."""
        paths = [self._path(b) for b in self.batches() if b != skip]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, batch: str) -> None:
        rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(batch))
        cols = self.spark.createDataFrame([], self.schema).columns
        rows.select(*cols).write.mode("overwrite").parquet(self._path(batch))

    def current(self, skip: str | None = None) -> DataFrame:
        merged = self.merge(self.rows(skip))
        return self.state(merged) if self.state else merged

    def compact(self) -> None:
        """Merge the batches that are there into one."""
        names = self.batches()
        if len(names) > 1:
            to = f"{max(names)}+"
            self.append(self.merge(self.rows()), to)
            for b in names:
                fs.delete(self.spark, self._path(b))


def keyed(spark: SparkSession, root: str, schema: str, key: list[str], keep: str = "last") -> BatchLog:
    """A log whose state is one row per key, that of the ``last`` or ``first`` batch."""
    names = spark.createDataFrame([], schema).columns
    rest = [c for c in names if c not in key]

    def merge(rows: DataFrame) -> DataFrame:
        # A null key column is a value of the key.
        pick = F.max if keep == "last" else F.min
        one = rows.groupBy(*key).agg(pick(F.struct("seq", *rest)).alias("x"))
        return one.select(*key, *[f"x.{c}" for c in rest], "x.seq")

    return BatchLog(spark, root, f"{schema}, seq string", merge, lambda m: m.select(*names))
