"""Join shapes Spark has no single operator for.

Both avoid a nested-loop / cartesian plan:

* range join: a row joins the intervals that contain its value. Values fall
  into the leaves of a binary tree over their quantiles; an interval becomes
  the O(log n) tree nodes that cover it exactly, a row its leaf's ancestors on
  the levels that intervals use. Both meet in an equi-join on (level, node), a
  pair once, and only the two end leaves of an interval need the exact test.
  An interval over the whole range is one row.
* as-of join: for each left row the nearest preceding right row with the
  same key. Both sides are unioned, ordered per key by time, and the last
  right row seen is carried forward with ``last(..., ignorenulls)`` over a
  window partitioned by key (no join at all). A key holding a third of all
  rows is one long partition sorted once; with ``salt_buckets`` the key is
  split into time ranges whose boundary carry-over is fixed up by a second,
  small pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import splittable_join
from ..session import cut_lineage


def _number(df: DataFrame, col: str) -> Column:
    """A column as a double, in its order."""
    kind = dict(df.dtypes)[col]
    c = F.col(f"`{col}`")
    return (c.cast("timestamp") if kind == "date" else c).cast("double")


def _leaf(value: Column, cuts: list[float], bits: int) -> Column:
    """The leaf of a value, never falling with it: the quantile bin by a
    binary search written as nested conditions, and the place inside the bin."""
    inside = 1 << bits

    def search(lo: int, hi: int) -> Column:     # bins lo..hi-1; bin i lies from cuts[i] to cuts[i + 1]
        if hi - lo == 1:
            width = cuts[hi] - cuts[lo]
            at = F.floor((value - F.lit(cuts[lo])) / F.lit(width) * inside) if width > 0 else F.lit(0)
            return F.lit(lo * inside).cast("long") + F.least(F.greatest(at.cast("long"), F.lit(0)), F.lit(inside - 1))
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid, hi))

    return search(0, len(cuts) - 1)


def _cover(lo: Column, hi: Column, levels: int) -> Column:
    """The tree nodes that cover leaves lo..hi exactly: array of (level, node)."""
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    start = F.struct(lo.alias("a"), hi.alias("b"), none.alias("out"))

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        left, right = (a <= b) & (a % 2 == 1), (a <= b) & (b % 2 == 0)
        right = right & ~(left & (a == b))
        one = lambda c, n: F.when(c, F.array(F.struct(level.alias("level"), n.alias("node")))).otherwise(none)
        a2, b2 = F.when(left, a + 1).otherwise(a), F.when(right, b - 1).otherwise(b)
        # Nothing left: keep it empty on the levels above.
        done = a2 > b2
        return F.struct(F.when(done, F.lit(1).cast("long")).otherwise(F.shiftright(a2, 1)).alias("a"), F.when(done, F.lit(0).cast("long")).otherwise(F.shiftright(b2, 1)).alias("b"),
                        F.concat(acc["out"], one(left, a), one(right, b)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["out"])


def range_join(points: DataFrame, value_col: str, ranges: DataFrame, lo_col: str, hi_col: str,
               bucket_width: float | None = None, how: str = "inner", bins: int = 64, bits: int = 10) -> DataFrame:
    """Join ``points`` to every range with ``lo <= value < hi``.

    ``bins`` quantiles of the values, each cut into 2 ** ``bits`` leaves; or
    plain buckets of ``bucket_width`` (an inner join for intervals that are
    about as long). ``how``: inner, left (points without a range stay), right,
    outer. Null values and bounds, and ranges with ``lo >= hi``, match nothing."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError("how must be inner, left, right or outer")
    cond = (F.col(value_col) >= F.col(lo_col)) & (F.col(value_col) < F.col(hi_col))
    if bucket_width is not None:
        if how != "inner":
            raise ValueError("bucket_width serves inner joins only")
        w = float(bucket_width)
        p = points.withColumn("_b", F.floor(F.col(value_col) / w).cast("long"))
        r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo_col) / w).cast("long"),
                                                         F.floor(F.col(hi_col) / w).cast("long"))))
        return p.join(r, "_b").filter(cond).drop("_b")
    p, r = points, ranges
    if how in ("left", "outer"):    # rows are told apart by a number that is pinned
        p = cut_lineage(p.withColumn("_pid", F.monotonically_increasing_id()))
    if how in ("right", "outer"):
        r = cut_lineage(r.withColumn("_rid", F.monotonically_increasing_id()))
    quantiles = p.select(_number(p, value_col).alias("v")).filter("v is not null and not isnan(v)").approxQuantile("v", [i / bins for i in range(bins + 1)], 0.25 / bins)
    cuts = sorted(set(quantiles)) or [0.0]
    cuts = [c for c in cuts if abs(c) != float("inf")] or [0.0]
    cuts = cuts if len(cuts) > 1 else [cuts[0], cuts[0]]
    levels = (len(cuts) - 1).bit_length() + bits
    good = r.filter(F.col(lo_col) < F.col(hi_col))
    nodes = good.withColumn("_n", F.explode(_cover(_leaf(_number(r, lo_col), cuts, bits), _leaf(_number(r, hi_col), cuts, bits), levels)))
    nodes = nodes.select(*r.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    used = sorted(x[0] for x in nodes.select("_level").distinct().collect())     # at most one number per level
    leaf = p.filter(F.col(value_col).isNotNull()).withColumn("_leaf", _leaf(_number(p, value_col), cuts, bits))
    asked = leaf.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in used]).cast("array<int>"))) \
                .withColumn("_node", F.expr("shiftright(_leaf, _level)")).drop("_leaf")
    met = splittable_join(asked, nodes, ["_level", "_node"], "inner").drop("_level", "_node").filter(cond)
    out = met
    if how in ("left", "outer"):
        out = out.unionByName(p.join(met.select("_pid").distinct(), "_pid", "left_anti"), allowMissingColumns=True)
    if how in ("right", "outer"):
        out = out.unionByName(r.join(met.select("_rid").distinct(), "_rid", "left_anti"), allowMissingColumns=True)
    return out.drop("_pid", "_rid").select(*points.columns, *[c for c in ranges.columns if c not in points.columns])


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
              right_cols: list, inclusive: bool = True, time_bucket: float | None = None) -> DataFrame:
    """For each left row: the values of the right row with the same key and
    the greatest ``right_ts`` <= ``left_ts`` (< when not inclusive); null if
    none. Ties among right rows at the same time: the last by right_cols.

    ``time_bucket`` (seconds for timestamps) splits every key into time
    ranges so a hot key is sorted by many tasks: pass 1 carries the last
    right row inside each (key, bucket); pass 2 fills left rows that saw none
    from the last right row of an EARLIER bucket, computed on a table with one
    row per (key, bucket).
    """
    lcols = left.columns
    rtypes = dict(right.dtypes)
    l_ = left.select(*[F.col(c) for c in lcols], F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
                     *[F.lit(None).cast(rtypes[c]).alias(f"_r_{c}") for c in right_cols])
    r_ = right.select(*[F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c != key],
                      F.col(key), F.col(right_ts).alias("_t"), F.lit(0 if inclusive else 2).alias("_side"),
                      *[F.col(c).alias(f"_r_{c}") for c in right_cols])
    u = l_.unionByName(r_.select(*l_.columns))
    rstruct = F.struct(*[F.col(f"_r_{c}").alias(c) for c in right_cols])
    order = [F.col("_t"), F.col("_side")] + [F.col(f"_r_{c}") for c in right_cols]
    if time_bucket is None:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = u.select("*", F.last(F.when(F.col("_side") != 1, rstruct), ignorenulls=True).over(w).alias("_m"))
        out = out.filter(F.col("_side") == 1)
        return out.select(*[F.col(c) for c in lcols], *[F.col(f"_m.{c}").alias(c) for c in right_cols])

    tnum = F.col("_t")
    if dict(u.dtypes)["_t"].startswith("timestamp") or dict(u.dtypes)["_t"] == "date":
        tnum = tnum.cast("timestamp").cast("double")
    u = u.withColumn("_bk", F.floor(tnum.cast("double") / float(time_bucket)).cast("long"))
    wl = Window.partitionBy(key, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    loc = u.select("*", F.last(F.when(F.col("_side") != 1, rstruct), ignorenulls=True).over(wl).alias("_m"))
    lefts = loc.filter(F.col("_side") == 1)
    # Last right row per (key, bucket), and each left bucket's predecessor.
    rl = (u.filter(F.col("_side") != 1).groupBy(key, "_bk")
          .agg(F.max_by(rstruct, F.struct(*order)).alias("_v")).withColumn("_s", F.lit(1)))
    lb = lefts.select(key, "_bk").distinct().withColumn("_v", F.lit(None).cast(rl.schema["_v"].dataType)) \
              .withColumn("_s", F.lit(0))
    wb = Window.partitionBy(key).orderBy("_bk", "_s").rowsBetween(Window.unboundedPreceding, -1)
    prev = (lb.unionByName(rl).select(key, "_bk", "_s", F.last("_v", ignorenulls=True).over(wb).alias("_p"))
            .filter(F.col("_s") == 0).drop("_s"))
    out = lefts.join(prev, [key, "_bk"], "left").withColumn("_m", F.coalesce("_m", "_p"))
    return out.select(*[F.col(c) for c in lcols], *[F.col(f"_m.{c}").alias(c) for c in right_cols])
