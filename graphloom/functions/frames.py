"""Small frame helpers shared by the report-style operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_row(parts: list, sets: dict | None = None) -> DataFrame:
    """One row with the row count of every ``(name, frame)`` in ``parts``
    (and, for every ``name -> single-column frame`` in ``sets``, the sorted
    distinct values of that column), computed by ONE aggregation over a
    union of tagged rows: no cross joins, partial counts map-side, and the
    value sets are deduplicated map-side (bounded by the number of distinct
    values, e.g. labels of a schema)."""
    sets = sets or {}
    u = None
    for name, df in parts:
        p = df.select(F.lit(name).alias("_k"), F.lit(None).cast("string").alias("_v"))
        u = p if u is None else u.unionByName(p)
    for name, df in sets.items():
        p = df.select(F.lit(name).alias("_k"), F.col(df.columns[0]).cast("string").alias("_v"))
        u = p if u is None else u.unionByName(p)
    aggs = [F.sum(F.when(F.col("_k") == name, 1).otherwise(0)).cast("long").alias(name) for name, _ in parts]
    aggs += [F.array_sort(F.collect_set(F.when(F.col("_k") == name, F.col("_v")))).alias(name) for name in sets]
    return u.agg(*aggs)


def splittable_join(left: DataFrame, right: DataFrame, keys: list, how: str) -> DataFrame:
    """Equi-join on ``keys`` (null keys match nothing) whose shuffles AQE can split.

    A side that comes out of an aggregation by the same keys is already
    partitioned by them; the join would reuse that partitioning, and a hot key
    of the other side would stay in one task. Joined on a struct of the keys,
    both sides get shuffles of their own, which the skew join may split."""
    names = {k: f"_r_{k}" for k in keys}
    r = right.withColumnsRenamed(names)
    for n in names.values():
        r = r.filter(F.col(f"`{n}`").isNotNull())
    cond = F.struct(*[left[f"`{k}`"].alias(k) for k in keys]) == F.struct(*[F.col(f"`{n}`").alias(k) for k, n in names.items()])
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())
