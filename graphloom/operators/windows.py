"""Window functions for keys that no single task should sort.

Spark's own window puts every row of a key into one task. The keys' rows are
counted first (a narrow aggregation): keys of up to ``HOT`` rows go to Spark's
own window, with one shuffle; only the others go in two passes. Those rows are
range-sorted by key and order, so a hot key lies in many pieces; each piece is
numbered and summed by itself, and what the pieces before it hold comes from
a table with one row per (key, piece). Rows near the border of a piece see
the rows beyond it through the few rows that every piece hands on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import splittable_join
from ..session import cut_lineage, pinned

#: A key with more rows than that is not sorted by one task.
HOT = 1 << 20


def _names(taken: list[str], *wanted: str) -> list[str]:
    out = []
    for w in wanted:
        while w in taken:
            w = "_" + w
        out.append(w)
    return out


def hot_keys(df: DataFrame, key: list[str], rows: int = HOT) -> DataFrame | None:
    """The keys with more than ``rows`` rows; None if there are none. At most one in ``rows`` rows is one."""
    found, n = pinned(df.groupBy(*[F.col(f"`{k}`") for k in key]).count().filter(F.col("count") > rows).drop("count"), "hot-keys")
    return found if n else None


def _parted(df: DataFrame, key: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the other rows, the rows of hot keys)."""
    h = F.broadcast(hot.select(*[F.col(f"`{k}`").alias(f"_h{i}") for i, k in enumerate(key)]))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(key)]
    return df.join(h, same, "left_anti"), df.join(h, same, "left_semi")


_ASK = object()


def scan(df: DataFrame, key: list[str], order: list[Column], row_number: str | None = None, sums: dict[str, str] | None = None,
         ntile: tuple[str, int] | None = None, near: dict[str, tuple[str, int]] | None = None, hot: DataFrame | None = _ASK) -> DataFrame:
    """``df`` with window columns over ``key`` in ``order``.

    ``row_number``: 1-based place (long); ``sums``: name -> column, its sum up
    to the row (nulls count nothing; null while there is no value);
    ``ntile``: (name, n); ``near``: name -> (column, distance), the value that
    many rows behind (negative) or ahead. Rows that ``order`` does not tell
    apart follow each other in any fixed order; null keys are a key. ``hot``:
    what :func:`hot_keys` found, where that is known already."""
    hot = hot_keys(df, key) if hot is _ASK else hot
    rest = df
    if hot is not None:
        rest, many = _parted(df, key, hot)
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in key]).orderBy(*order)
    made = {row_number: F.row_number().over(w).cast("long")} if row_number else {}
    made |= {name: F.sum(f"`{c}`").over(w.rowsBetween(Window.unboundedPreceding, 0)) for name, c in (sums or {}).items()}
    made |= {ntile[0]: F.ntile(ntile[1]).over(w).cast("long")} if ntile else {}
    made |= {name: (F.lag(f"`{c}`", -d) if d < 0 else F.lead(f"`{c}`", d)).over(w) for name, (c, d) in (near or {}).items()}
    rest = rest.select("*", *[c.alias(name) for name, c in made.items()])
    return rest if hot is None else rest.unionByName(_scan_pieces(many, key, order, row_number, sums, ntile, near))


def _scan_pieces(df: DataFrame, key: list[str], order: list[Column], row_number: str | None, sums: dict[str, str] | None,
                 ntile: tuple[str, int] | None, near: dict[str, tuple[str, int]] | None) -> DataFrame:
    sums, near = sums or {}, near or {}
    piece, at, first, n, base = _names(df.columns, "_piece", "_at", "_first", "_n", "_base")
    cols = [F.col(f"`{k}`") for k in key]
    # Range-sorted, and pinned: piece and place stay what they are if a task runs again.
    rows = df.orderBy(*cols, *order).withColumn(at, F.monotonically_increasing_id())
    rows = cut_lineage(rows.withColumn(piece, F.shiftright(at, 33)))
    per = [*[F.col(f"`{k}`") for k in key], F.col(piece)]
    local = Window.partitionBy(*per).orderBy(at)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(n, F.row_number().over(local))
    part = {name: f"{base}_{name}" for name in sums}
    rows = rows.withColumns({part[name]: F.sum(f"`{c}`").over(upto) for name, c in sums.items()}) if sums else rows
    reach = max([abs(d) for _, d in near.values()] or [0])
    for name, (c, d) in near.items():
        rows = rows.withColumn(name, F.lag(f"`{c}`", -d).over(local) if d < 0 else F.lead(f"`{c}`", d).over(local))
    # One row per key and piece: what it holds, and (for near) the rows at its borders.
    held = rows.groupBy(*per).agg(F.max(n).alias("_rows"), *[F.sum(f"`{c}`").alias(f"_sum_{name}") for name, c in sums.items()])
    before = Window.partitionBy(*[F.col(f"`{k}`") for k in key]).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*[F.col(f"`{k}`") for k in key])
    held = held.select(*per, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(first), F.sum("_rows").over(whole).alias("_all"), F.col("_rows").alias("_size"),
                       *[F.sum(f"_sum_{name}").over(before).alias(f"_sum_{name}") for name in sums])
    renamed = held.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(key)} | {piece: "_kp"})
    same = F.col(piece) == F.col("_kp")
    for i, k in enumerate(key):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(renamed, same).drop("_kp", *[f"_k{i}" for i in range(len(key))])
    place = F.col(first) + F.col(n)
    made: dict[str, Column] = {name: F.when(F.col(part[name]).isNull(), F.col(f"_sum_{name}")).when(F.col(f"_sum_{name}").isNull(), F.col(part[name]))
                               .otherwise(F.col(part[name]) + F.col(f"_sum_{name}")) for name in sums}
    if row_number:
        made[row_number] = place.cast("long")
    if ntile:
        name, k = ntile
        size, rest = F.floor(F.col("_all") / k), F.col("_all") % k
        made[name] = F.when(place <= rest * (size + 1), F.floor((place - 1) / (size + 1))).otherwise(
            rest + F.floor((place - 1 - rest * (size + 1)) / F.greatest(size, F.lit(1)))).cast("long") + 1
    out = out.withColumns(made) if made else out
    if near:
        out = _across(out, key, n, place, near, reach)
    return out.drop(piece, at, first, n, "_all", "_size", *part.values(), *[f"_sum_{name}" for name in sums])


def _across(out: DataFrame, key: list[str], n: str, place: Column, near: dict, reach: int) -> DataFrame:
    """Values beyond the border of a piece: the rows within ``reach`` of one
    are at most ``2 * reach`` per piece, and join by their place in the key."""
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(key)]
    border = (F.col(n) <= reach) | (F.col(n) > F.col("_size") - reach)
    values = sorted({c for c, _ in near.values()})
    edge = out.filter(border).select(*[F.col(f"`{k}`").alias(f"_e{i}") for i, k in enumerate(key)], place.alias("_eat"),
                                     F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(values)]).alias("_ev"))
    for name, (c, d) in near.items():
        outside = (F.col(n) + d < 1) | (F.col(n) + d > F.col("_size"))
        value = F.col(f"_ev.v{values.index(c)}")
        want = F.when(outside, place + d)       # null for most rows: they match nothing
        j = out.withColumn("_want", want)
        hit = j.filter("_want is not null").join(edge, reduce(lambda x, y: x & y, same, F.col("_want") == F.col("_eat")), "left") \
               .withColumn(name, value).drop("_eat", "_ev", *[f"_e{i}" for i in range(len(key))])
        out = j.filter("_want is null").unionByName(hit).drop("_want")
    return out


def ranks(df: DataFrame, key: list[str], order: list[str], rank: str | None = None, dense_rank: str | None = None,
          hot: DataFrame | None = _ASK) -> DataFrame:
    """``df`` with rank and/or dense_rank over ``key`` by the columns ``order``
    (ascending, nulls first); ``hot`` as in :func:`scan`."""
    hot = hot_keys(df, key) if hot is _ASK else hot
    rest = df
    if hot is not None:
        rest, many = _parted(df, key, hot)
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in key]).orderBy(*[F.col(f"`{c}`") for c in order])
    made = {x: f.over(w) for x, f in ((rank, F.rank()), (dense_rank, F.dense_rank())) if x}
    rest = rest.select("*", *[c.cast("long").alias(x) for x, c in made.items()])
    return rest if hot is None else rest.unionByName(_rank_pieces(many, key, order, rank, dense_rank))


def _rank_pieces(df: DataFrame, key: list[str], order: list[str], rank: str | None, dense_rank: str | None) -> DataFrame:
    """Ties are counted first: what is scanned is one row per (key, distinct
    value), and its ranks join back."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in (*key, *order)]).agg(F.count(F.lit(1)).alias("_ties"))
    groups = _scan_pieces(groups, key, [F.col(f"`{c}`") for c in order], "_dense", {"_upto": "_ties"}, None, None)
    made = {x: e for x, e in ((rank, F.col("_upto") - F.col("_ties") + 1), (dense_rank, F.col("_dense"))) if x}
    groups = groups.select(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string") for c in (*key, *order)]), {"ignoreNullFields": "false"}).alias("_group"), *[e.cast("long").alias(x) for x, e in made.items()])
    named = df.withColumn("_group", F.to_json(F.struct(*[F.col(f"`{c}`").cast("string") for c in (*key, *order)]), {"ignoreNullFields": "false"}))
    return splittable_join(named, groups, ["_group"], "inner").drop("_group")
