"""Hydration, post-join and SQL over results.

Hydration is one lazy left join with the de-duplicated wide source (AQE
broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold``, and splits hot keys).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import splittable_join
from ..functions.types import TYPE_BIGINT, TYPE_BOOLEAN, TYPE_DOUBLE, TYPE_VARCHAR
from ..graph import PropertyGraph
from .match import node_attrs

_REL_RX = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def dedupe_last(wide: DataFrame, key: str, order_by: list | None = None) -> DataFrame:
    """One row per key: the last row by ``order_by`` (then the row's values)."""
    others = [c for c in wide.columns if c != key]
    if not others:
        return wide.select(key).distinct()
    seq = F.struct(*[F.col(_q(c)) for c in (order_by or [])], *[F.col(_q(c)) for c in others])
    row = F.struct(*[F.col(_q(c)).alias(c) for c in others])
    out = wide.groupBy(_q(key)).agg(F.max_by(row, seq).alias("_w"))
    return out.select(F.col(_q(key)), *[F.col("_w." + _q(c)).alias(c) for c in others])


def hydrate(result: DataFrame, wide: DataFrame, key: str = "NODE", columns="*",
            order_by: list | None = None, reduce_wide: bool = False, unique_wide: bool = False) -> DataFrame:
    """G1: LEFT join result rows to the wide source on ``key``.

    Null-key rows are dropped; result duplicates kept; matched rows take the
    wide value of same-named columns even when null; unmatched rows keep
    their own; duplicate wide keys -> last row wins.

    One lazy plan: the wide side is de-duplicated (not with ``unique_wide``,
    when its keys are known to be unique) and left-joined, so filters and
    column pruning of what follows reach both scans. A hot key of the result
    is split by the skew join. ``reduce_wide`` first cuts the wide side to
    the result's keys: it saves the de-duplication of a huge source, and runs
    the result's plan once more.
    """
    if columns != "*":
        cols = list(columns)
        if key not in cols:
            raise ValueError(f"columns must include the key {key!r}")
        wide = wide.select(*[F.col(_q(c)) for c in cols + [o for o in (order_by or []) if o not in cols]])
    res = result.filter(F.col(_q(key)).isNotNull())
    if reduce_wide:
        wide = wide.join(res.select(F.col(_q(key))).distinct(), key, "left_semi")
    w = wide if unique_wide else dedupe_last(wide, key, order_by)
    if columns != "*":
        w = w.select(*[F.col(_q(c)) for c in columns])
    wcols = [c for c in w.columns if c != key]
    w = w.select(F.col(_q(key)), F.lit(True).alias("_matched"),
                 *[F.col(_q(c)).alias(f"_w_{c}") for c in wcols])
    j = splittable_join(res, w, [key], "left")
    out = []
    for c in result.columns:
        if c in wcols:
            out.append(F.when(F.col("_matched"), F.col(_q(f"_w_{c}"))).otherwise(F.col(_q(c))).alias(c))
        else:
            out.append(F.col(_q(c)))
    out += [F.col(_q(f"_w_{c}")).alias(c) for c in wcols if c not in result.columns]
    return j.select(*out)


def _check_rel(name: str) -> str:
    if not _REL_RX.match(name or ""):
        raise ValueError(f"invalid relation name: {name!r}")
    return name


def post_join(result: DataFrame, wide: DataFrame, join_sql: str,
              cypher_relation: str = "cypher", wide_relation: str = "wide") -> DataFrame:
    """Run ``join_sql`` over relations ``cypher`` (result) and ``wide``.

    An empty result gives no rows (so ``COUNT(*)`` yields no 0-row): the
    output is filtered by an uncorrelated ``EXISTS`` over the result, which
    stops at its first row; nothing runs before the output is used.
    """
    spark = result.sparkSession
    _check_rel(cypher_relation)
    _check_rel(wide_relation)
    result.createOrReplaceTempView(cypher_relation)
    wide.createOrReplaceTempView(wide_relation)
    return spark.sql(join_sql).filter(F.expr(f"EXISTS (SELECT 1 FROM {cypher_relation})"))


def candidate_ids(result: DataFrame) -> DataFrame:
    """All distinct non-null string values in any column of a result."""
    cols = [f.name for f in result.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return result.sparkSession.createDataFrame([], "id string")
    arr = F.array(*[F.col(_q(c)) for c in cols])
    return (result.select(F.explode(arr).alias("id")).filter(F.col("id").isNotNull()).distinct())


def post_join_rows(g: PropertyGraph, result: DataFrame, join_sql: str,
                   cypher_relation: str = "cypher", wide_relation: str = "wide") -> DataFrame:
    """Post-join with ``wide`` = the graph's own attributes of the ids
    that appear in the result."""
    wide = node_attrs(g, candidate_ids(result), id_col="id")
    return post_join(result, wide, join_sql, cypher_relation, wide_relation)


def match_then_post_join(result: DataFrame, wide: DataFrame, join_sql: str,
                         key: str = "NODE", **kw) -> DataFrame:
    """Traversal rows -> drop null-key rows (only if the key column
    exists) -> post-join SQL, as one lazy plan."""
    if key in result.columns:
        result = result.filter(F.col(_q(key)).isNotNull())
    return post_join(result, wide, join_sql, **kw)


def rank_by_path_count(paths: DataFrame, wide: DataFrame, key: str, attr: str,
                       out_col: str = "n", order_by: list | None = None, weight: str | None = None) -> DataFrame:
    """Path count per wide attribute, ranked (highest first).

    ``paths`` has a row per path or, with ``weight``, a row per key and the
    number of its paths in that column, as :func:`paths.count_paths` gives it
    without making any path.

    Paths are pre-aggregated per key BEFORE anything else (one row per key
    instead of one per path, partial counts map-side, so a hub key holding a
    third of all paths costs one row per task); the wide attribute is read as
    two columns, de-duplicated per key and joined on the same partitioning;
    the final group by attribute is tiny.
    """
    per_key = paths.filter(F.col(_q(key)).isNotNull()).groupBy(_q(key)).agg(
        (F.sum(_q(weight)) if weight else F.count(F.lit(1))).alias("_c"))
    w = wide.select(_q(key), _q(attr), *[F.col(_q(o)) for o in (order_by or []) if o not in (key, attr)])
    w = dedupe_last(w, key, order_by).select(_q(key), _q(attr))
    j = per_key.join(w, key, "left")
    return (j.groupBy(_q(attr)).agg(F.sum("_c").alias(out_col))
            .orderBy(F.col(out_col).desc(), F.col(_q(attr)).asc_nulls_last()))


def graph_attr_source(g: PropertyGraph, result: DataFrame, columns: list | None = None) -> DataFrame:
    """G6 step 1: the graph's own attributes of every id appearing in the
    result, keeping only rows that carry at least one attribute beyond NODE.
    With ``columns``, only those attributes are considered; ones the graph
    does not have read as null (so a skinny graph yields no rows)."""
    wide = node_attrs(g, candidate_ids(result), id_col="id")
    if columns is not None:
        wide = wide.select("NODE", *[F.col(_q(c)) if c in wide.columns else F.lit(None).cast("string").alias(c)
                                     for c in columns])
    cols = [c for c in wide.columns if c != "NODE"]
    has = None
    for c in cols:
        x = F.col(_q(c)).isNotNull()
        has = x if has is None else has | x
    return wide.filter(has) if has is not None else wide.filter(F.lit(False))


def post_join_cascade(result: DataFrame, sources: list, join_sql: str | None = None,
                      cypher_relation: str = "cypher", wide_relation: str = "wide") -> DataFrame:
    """Try each wide source in order (e.g. graph attributes, then a
    file); the first whose post-join yields rows wins and is tagged in
    ``hydrate_from``; if none does, the raw result rows come back tagged null.

    ``sources`` items are ``(tag, DataFrame)`` or ``(tag, DataFrame, sql)``
    (per-source SQL; default ``join_sql``). Which source wins depends on the
    data, so each is run, once: its output is pinned (reliable checkpoint)."""
    from ..session import cut_lineage
    for item in sources:
        tag, wide = item[0], item[1]
        sql = item[2] if len(item) > 2 else join_sql
        out = cut_lineage(post_join(result, wide, sql, cypher_relation, wide_relation))
        if not out.isEmpty():
            return out.withColumn("hydrate_from", F.lit(tag))
    return result.withColumn("hydrate_from", F.lit(None).cast("string"))


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Ad-hoc SQL over registered tables/views."""
    return spark.sql(sql)


def variant_types(df: DataFrame, json_col: str, id_cols: list | None = None) -> DataFrame:
    """Long form of a JSON-object column: (id..., key, type) with one row per
    key of each object; type from the JSON value (BOOLEAN/BIGINT/DOUBLE/
    VARCHAR, JSON null -> null)."""
    ids = [F.col(_q(c)) for c in (id_cols or [])]
    m = F.from_json(F.col(_q(json_col)), "map<string,variant>")
    ex = df.select(*ids, F.explode(m).alias("key", "_v"))
    typ = F.schema_of_variant(F.col("_v"))
    t = (F.when(typ == "BOOLEAN", F.lit(TYPE_BOOLEAN))
         .when(typ.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(TYPE_BIGINT))
         .when(typ.startswith("DECIMAL") | typ.isin("DOUBLE", "FLOAT"), F.lit(TYPE_DOUBLE))
         .when(typ == "VOID", F.lit(None).cast("string"))
         .otherwise(F.lit(TYPE_VARCHAR)))
    return ex.select(*ids, "key", t.alias("type"), F.col("_v").alias("value"))


def infer_column_types(df: DataFrame, json_col: str) -> DataFrame:
    """Type of each key from ALL non-null values: all bool -> BOOLEAN;
    all int -> BIGINT; ints and floats -> DOUBLE; none or mixed -> VARCHAR.
    Columns ``column``, ``type``."""
    long = variant_types(df, json_col)
    agg = long.groupBy(F.col("key").alias("column")).agg(
        F.array_sort(F.collect_set("type")).alias("ts"))
    ts = F.col("ts")
    rule = (F.when(F.size(ts) == 0, F.lit(TYPE_VARCHAR))
            .when((F.size(ts) == 1) & (ts[0] == TYPE_BOOLEAN), F.lit(TYPE_BOOLEAN))
            .when((F.size(ts) == 1) & (ts[0] == TYPE_BIGINT), F.lit(TYPE_BIGINT))
            .when((F.size(ts) == 1) & (ts[0] == TYPE_DOUBLE), F.lit(TYPE_DOUBLE))
            .when((F.size(ts) == 2) & (ts[0] == TYPE_BIGINT) & (ts[1] == TYPE_DOUBLE), F.lit(TYPE_DOUBLE))
            .otherwise(F.lit(TYPE_VARCHAR)))
    return agg.select("column", rule.alias("type"))
