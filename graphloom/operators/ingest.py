"""Incremental ingest into a stored graph.

State as a reader sees it:

``nodes``: NODE, labels (label vector, overwritten), label_set (accumulated
graph labels), label_raw, name, attrs ``map<string,string>`` whose values are
JSON texts (so their types survive), first_seen_ts, last_seen_ts.
``edges``: ID, src, dst, type, attrs, first_seen_ts, last_seen_ts.

``merge_nodes``/``merge_edges`` merge a batch into a state frame with ONE full
outer join on the key. Stored state is a log of batches instead
(:mod:`graphloom.operators.batch_log`): :func:`node_rows`/:func:`edge_rows` are
what a batch appends, and the state is an aggregation over the log, so a batch
costs what the batch holds, whatever the state's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import DEFAULT_NODE_AXIS, SAFE_IDENT_PATTERN
from ..functions.types import (SPARK_TYPE, TRUE_STRINGS, TYPE_BIGINT, TYPE_BOOLEAN,
                               TYPE_DOUBLE, TYPE_VARCHAR)
from .batch_log import BatchLog

NODE_STATE_SCHEMA = ("NODE string, labels array<string>, label_set array<string>, "
                     "label_raw array<string>, name string, attrs map<string,string>, "
                     "first_seen_ts timestamp, last_seen_ts timestamp")
EDGE_STATE_SCHEMA = ("ID string, src string, dst string, type string, attrs map<string,string>, "
                     "first_seen_ts timestamp, last_seen_ts timestamp")

# Columns that are never attribute columns.
NODE_BASE_COLS = ["NODE", "LABEL", "name", "entity_name"]
EDGE_BASE_COLS = ["edge_key", "NODE1", "NODE2", "LABEL"]


def empty_nodes(spark) -> DataFrame:
    return spark.createDataFrame([], NODE_STATE_SCHEMA)


def empty_edges(spark) -> DataFrame:
    return spark.createDataFrame([], EDGE_STATE_SCHEMA)


def _merge_batch_attrs(batch: DataFrame, key: list, seq: Column) -> DataFrame:
    """Per key: attrs merged over the batch's rows, later rows (by ``seq``)
    winning per attribute key. Returns key + attrs."""
    kv = (batch.select(*key, seq.alias("_seq"), F.explode_outer("attrs").alias("k", "v"))
          .filter(F.col("k").isNotNull()))
    per = kv.groupBy(*key, "k").agg(F.max_by("v", "_seq").alias("v"))
    return per.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attrs"))


def normalize_node_batch(batch: DataFrame, seq: Column | None = None) -> DataFrame:
    """Batch rows -> one row per id: labels (falls back to [label]) and
    label_raw (falls back to labels) from the last row, label_set = all
    labels seen, name last non-null, attrs merged (later wins)."""
    cols = batch.columns
    lbl = F.col("label") if "label" in cols else F.lit(None).cast("string")
    labels = F.col("labels") if "labels" in cols else F.lit(None).cast("array<string>")
    labels = F.when(F.size(F.coalesce(labels, F.array())) > 0, labels).otherwise(
        F.when(lbl.isNotNull() & (lbl != ""), F.array(lbl)).otherwise(F.array().cast("array<string>")))
    raw = F.col("label_raw") if "label_raw" in cols else F.lit(None).cast("array<string>")
    raw = F.when(F.size(F.coalesce(raw, F.array())) > 0, raw).otherwise(labels)
    name = F.col("name") if "name" in cols else F.lit(None).cast("string")
    attrs = F.col("attrs") if "attrs" in cols else F.lit(None).cast("map<string,string>")
    seq = seq if seq is not None else F.struct(*[F.col(c) for c in cols if c not in ("attrs",)])
    b = (batch.filter(F.col("id").isNotNull())
         .select(F.col("id").cast("string").alias("NODE"), labels.alias("labels"), raw.alias("label_raw"),
                 name.alias("name"), attrs.alias("attrs"), seq.alias("_seq")))
    one = b.groupBy("NODE").agg(
        F.max_by(F.struct("labels", "label_raw"), "_seq").alias("_last"),
        # collect_set dedupes map-side: a node repeated in a third of the
        # batch keeps one copy per distinct label vector, not one per row.
        F.array_distinct(F.flatten(F.collect_set("labels"))).alias("label_set"),
        F.expr("max_by(name, _seq) FILTER (WHERE name IS NOT NULL)").alias("name"))
    at = _merge_batch_attrs(b, ["NODE"], F.col("_seq"))
    return (one.join(at, "NODE", "left")
            .select("NODE", "_last.labels", "label_set", "_last.label_raw", "name",
                    F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs")))


def _merge_maps(old: Column, new: Column) -> Column:
    """Old attrs with keys of ``new`` removed, then ``new`` (new keys win)."""
    o = F.coalesce(old, F.create_map().cast("map<string,string>"))
    n = F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.array_contains(F.map_keys(n), k)), n)


def merge_nodes(state: DataFrame, batch: DataFrame, now, seq: Column | None = None) -> DataFrame:
    """Upsert a batch of extracted nodes (returns the new state).

    On create: first_seen_ts = now; always last_seen_ts = now; labels and
    label_raw overwritten; label_set accumulates; attrs merged (new keys
    win, other keys kept); name kept unless the batch has one."""
    nowc = F.lit(now).cast("timestamp")
    b = normalize_node_batch(batch, seq).alias("b")
    s = state.alias("s")
    j = s.join(b, F.col("s.NODE") == F.col("b.NODE"), "full_outer")
    hit = F.col("b.NODE").isNotNull()
    return j.select(
        F.coalesce("b.NODE", "s.NODE").alias("NODE"),
        F.when(hit, F.col("b.labels")).otherwise(F.col("s.labels")).alias("labels"),
        F.array_distinct(F.concat(F.coalesce("s.label_set", F.array().cast("array<string>")),
                                  F.coalesce("b.label_set", F.array().cast("array<string>")))).alias("label_set"),
        F.when(hit, F.col("b.label_raw")).otherwise(F.col("s.label_raw")).alias("label_raw"),
        F.coalesce("b.name", "s.name").alias("name"),
        F.when(hit, _merge_maps(F.col("s.attrs"), F.col("b.attrs"))).otherwise(F.col("s.attrs")).alias("attrs"),
        F.coalesce(F.col("s.first_seen_ts"), nowc).alias("first_seen_ts"),
        F.when(hit, nowc).otherwise(F.col("s.last_seen_ts")).alias("last_seen_ts"))


def normalize_edge_batch(batch: DataFrame, nodes: DataFrame | None, seq: Column | None = None) -> DataFrame:
    cols = batch.columns
    attrs = F.col("attrs") if "attrs" in cols else F.lit(None).cast("map<string,string>")
    seq = seq if seq is not None else F.struct(*[F.col(c) for c in cols if c != "attrs"])
    b = (batch.filter(F.col("id").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
         .select(F.col("id").cast("string").alias("ID"), F.col("src").cast("string").alias("src"),
                 F.col("dst").cast("string").alias("dst"), F.col("label").alias("type"),
                 attrs.alias("attrs"), seq.alias("_seq")))
    if nodes is not None:
        ids = nodes.select("NODE")
        b = (b.join(ids.withColumnRenamed("NODE", "src"), "src", "left_semi")
              .join(ids.withColumnRenamed("NODE", "dst"), "dst", "left_semi"))
    key = ["src", "dst", "type", "ID"]
    one = b.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    at = _merge_batch_attrs(b, key, F.col("_seq")).withColumnRenamed("type", "_t")
    same = [one[k] == at[k] for k in ("src", "dst", "ID")]
    return (one.join(at, same[0] & same[1] & same[2] & F.col("type").eqNullSafe(F.col("_t")), "left").select(
        *[one[k] for k in key], F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs")))


def merge_edges(state: DataFrame, batch: DataFrame, nodes: DataFrame, now,
                seq: Column | None = None) -> DataFrame:
    """Upsert edges; null id/src/dst dropped; both endpoints must exist
    in ``nodes`` (the state after C1); identity (src, dst, type, ID)."""
    nowc = F.lit(now).cast("timestamp")
    b = normalize_edge_batch(batch, nodes, seq).alias("b")
    s = state.alias("s")
    key = ["src", "dst", "type", "ID"]
    cond = None
    for k in key:
        c = F.col(f"s.{k}") == F.col(f"b.{k}")
        cond = c if cond is None else cond & c
    j = s.join(b, cond, "full_outer")
    hit = F.col("b.ID").isNotNull()
    return j.select(
        *[F.coalesce(f"b.{k}", f"s.{k}").alias(k) for k in ["ID", "src", "dst", "type"]],
        F.when(hit, _merge_maps(F.col("s.attrs"), F.col("b.attrs"))).otherwise(F.col("s.attrs")).alias("attrs"),
        F.coalesce(F.col("s.first_seen_ts"), nowc).alias("first_seen_ts"),
        F.when(hit, nowc).otherwise(F.col("s.last_seen_ts")).alias("last_seen_ts"))


# Stored rows: every value with the id of the batch that brought it.
NODE_LOG_SCHEMA = ("NODE string, last struct<seq:string,labels:array<string>,label_raw:array<string>>, label_set array<string>, "
                   "named struct<seq:string,name:string>, attrs map<string,struct<seq:string,v:string>>, "
                   "first_seen_ts timestamp, last_seen_ts timestamp, seq string")
EDGE_LOG_SCHEMA = ("ID string, src string, dst string, type string, attrs map<string,struct<seq:string,v:string>>, "
                   "first_seen_ts timestamp, last_seen_ts timestamp, seq string")
EDGE_KEY = ["src", "dst", "type", "ID"]


def _stamped(attrs: Column, seq: Column) -> Column:
    return F.transform_values(attrs, lambda k, v: F.struct(seq.alias("seq"), v.alias("v")))


def node_rows(batch: DataFrame, now, batch_id: str, seq: Column | None = None) -> DataFrame:
    """C1 as a log: what a batch of extracted nodes appends (one row per id)."""
    b, s, nowc = normalize_node_batch(batch, seq), F.lit(batch_id), F.lit(now).cast("timestamp")
    return b.select("NODE", F.struct(s.alias("seq"), "labels", "label_raw").alias("last"), "label_set",
                    F.when(F.col("name").isNotNull(), F.struct(s.alias("seq"), "name")).alias("named"), _stamped(F.col("attrs"), s).alias("attrs"),
                    nowc.alias("first_seen_ts"), nowc.alias("last_seen_ts"), s.alias("seq"))


def edge_rows(batch: DataFrame, now, batch_id: str, seq: Column | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """C2 as a log: null id/src/dst dropped; with ``nodes`` only edges whose
    ends are there, otherwise ends are checked when the state is read."""
    b, s, nowc = normalize_edge_batch(batch, nodes, seq), F.lit(batch_id), F.lit(now).cast("timestamp")
    return b.select("ID", "src", "dst", "type", _stamped(F.col("attrs"), s).alias("attrs"),
                    nowc.alias("first_seen_ts"), nowc.alias("last_seen_ts"), s.alias("seq"))


def _merged_attrs(rows: DataFrame, key: list) -> DataFrame:
    """Per key: every attribute's last value. Null key columns are equal."""
    per = rows.select(*key, F.explode("attrs").alias("k", "v")).groupBy(*key, "k").agg(F.max("v").alias("v"))
    return per.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attrs"))


def _with_attrs(one: DataFrame, attrs: DataFrame, key: list) -> DataFrame:
    at = attrs.withColumnsRenamed({k: f"_a_{k}" for k in key})
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_a_{k}"))
    none = F.create_map().cast("map<string,struct<seq:string,v:string>>")
    return one.join(at, cond, "left").withColumn("attrs", F.coalesce("attrs", none))


def merge_node_rows(rows: DataFrame) -> DataFrame:
    """One stored row per node."""
    one = rows.groupBy("NODE").agg(
        F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_set("label_set"))).alias("label_set"), F.max("named").alias("named"),
        F.min("first_seen_ts").alias("first_seen_ts"), F.max("last_seen_ts").alias("last_seen_ts"), F.max("seq").alias("seq"))
    return _with_attrs(one, _merged_attrs(rows, ["NODE"]), ["NODE"]).select(
        "NODE", "last", "label_set", "named", "attrs", "first_seen_ts", "last_seen_ts", "seq")


def node_state(merged: DataFrame) -> DataFrame:
    return merged.select("NODE", "last.labels", "label_set", "last.label_raw", F.col("named.name").alias("name"),
                         F.transform_values("attrs", lambda k, v: v["v"]).alias("attrs"), "first_seen_ts", "last_seen_ts")


def merge_edge_rows(rows: DataFrame) -> DataFrame:
    """One stored row per edge."""
    one = rows.groupBy(*EDGE_KEY).agg(F.min("first_seen_ts").alias("first_seen_ts"), F.max("last_seen_ts").alias("last_seen_ts"), F.max("seq").alias("seq"))
    return _with_attrs(one, _merged_attrs(rows, EDGE_KEY), EDGE_KEY).select("ID", "src", "dst", "type", "attrs", "first_seen_ts", "last_seen_ts", "seq")


def edge_state(merged: DataFrame) -> DataFrame:
    return merged.select("ID", "src", "dst", "type", F.transform_values("attrs", lambda k, v: v["v"]).alias("attrs"), "first_seen_ts", "last_seen_ts")


def node_log(spark, root: str) -> BatchLog:
    return BatchLog(spark, root, NODE_LOG_SCHEMA, merge_node_rows, node_state)


def edge_log(spark, root: str) -> BatchLog:
    return BatchLog(spark, root, EDGE_LOG_SCHEMA, merge_edge_rows, edge_state)


def ingest_report(state_nodes: DataFrame, state_edges: DataFrame, batch_nodes: DataFrame,
                  batch_edges: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """nodes/edges ensured present vs newly created, and the sorted
    distinct labels of the batch. One row."""
    bn = normalize_node_batch(batch_nodes)
    be = normalize_edge_batch(batch_edges, new_nodes)
    created_n = bn.join(state_nodes.select("NODE"), "NODE", "left_anti")
    key = ["src", "dst", "type", "ID"]
    created_e = be.join(state_edges.select(*key), key, "left_anti")
    from ..functions.frames import counts_row
    return counts_row([("nodes", bn.select("NODE")), ("nodes_created", created_n.select("NODE")),
                       ("edges", be.select("ID")), ("edges_created", created_e.select("ID"))],
                      sets={"labels": bn.select(F.explode("labels").alias("l"))})


def _variant_type(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (F.when(t == "BOOLEAN", F.lit(TYPE_BOOLEAN))
            .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(TYPE_BIGINT))
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), F.lit(TYPE_DOUBLE))
            .when(t == "VOID", F.lit(None).cast("string"))
            .otherwise(F.lit(TYPE_VARCHAR)))


def discover_attr_columns(elements: DataFrame, base_cols=None, seq: Column | None = None) -> DataFrame:
    """C4: union of attribute keys -> (column, type). Base columns and keys
    that are not safe identifiers are skipped; the type comes from the FIRST
    non-null value (by ``seq``); keys seen only with null -> VARCHAR.

    ``elements.attrs`` is ``map<string,string>`` of JSON texts."""
    base = list(base_cols if base_cols is not None else NODE_BASE_COLS)
    seq = seq if seq is not None else F.struct(*[F.col(c) for c in elements.columns if c != "attrs"])
    kv = (elements.select(seq.alias("_seq"), F.explode("attrs").alias("k", "v"))
          .filter(~F.col("k").isin(base) & F.col("k").rlike(SAFE_IDENT_PATTERN))
          .withColumn("_t", _variant_type(F.try_parse_json("v"))))
    agg = kv.groupBy(F.col("k").alias("column")).agg(
        F.expr("min_by(_t, _seq) FILTER (WHERE _t IS NOT NULL)").alias("_t"))
    return agg.select("column", F.coalesce("_t", F.lit(TYPE_VARCHAR)).alias("type"))


def evolve_columns(declared: DataFrame, discovered: DataFrame) -> DataFrame:
    """Add only missing columns; a declared type never changes.
    Both inputs are (column, type); returns the accumulated column list."""
    new = discovered.join(declared.select("column"), "column", "left_anti")
    return declared.select("column", "type").unionByName(new.select("column", "type"))


def coerce_value(v_json: Column, col_type: str) -> Column:
    """Best-effort cast of one JSON-text attribute value to ``col_type``.

    BIGINT: numbers truncate, booleans 1/0, strings must parse as integers
    ('3.7' -> null); DOUBLE likewise; BOOLEAN: booleans as is, strings by
    membership of lower(trim(s)) in TRUE_STRINGS (else FALSE), numbers by
    non-zero; VARCHAR: strings unquoted, other values as JSON text.
    """
    v = F.try_parse_json(v_json)
    t = F.schema_of_variant(v)
    is_str = t == "STRING"
    is_bool = t == "BOOLEAN"
    is_num = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    s = F.try_variant_get(v, "$", "string")
    if col_type == TYPE_BIGINT:
        return (F.when(is_num, F.try_variant_get(v, "$", "double").cast("bigint"))
                .when(is_bool, F.try_variant_get(v, "$", "boolean").cast("bigint"))
                .when(is_str, F.trim(s).try_cast("bigint")))
    if col_type == TYPE_DOUBLE:
        return (F.when(is_num, F.try_variant_get(v, "$", "double"))
                .when(is_bool, F.try_variant_get(v, "$", "boolean").cast("double"))
                .when(is_str, F.trim(s).try_cast("double")))
    if col_type == TYPE_BOOLEAN:
        return (F.when(is_bool, F.try_variant_get(v, "$", "boolean"))
                .when(is_str, F.lower(F.trim(s)).isin(TRUE_STRINGS))
                .when(is_num, F.try_variant_get(v, "$", "double") != 0))
    return F.when(is_str, s).when(v.isNotNull() & (t != "VOID"), F.to_json(v))


def coerce_attrs(elements: DataFrame, columns: dict, key: str = "NODE") -> DataFrame:
    """C6 over a frame: key + one typed column per declared attribute."""
    return elements.select(F.col(key), *[
        coerce_value(F.col("attrs")[c], t).cast(SPARK_TYPE[t]).alias(c) for c, t in columns.items()])


def materialize_label_keys(nodes: DataFrame, ontology: DataFrame | None = None,
                           default_axis: str = DEFAULT_NODE_AXIS) -> DataFrame:
    """Axis table from the FULL accumulated label set: axis -> sorted
    distinct labels (default axis EntityType; ontology axis when known).
    Columns label_key, label (array)."""
    labs = nodes.select(F.explode("labels").alias("lbl")).distinct()
    if ontology is not None:
        ax = (ontology.filter(F.col("type_kind") == "entity")
              .groupBy(F.col("type_name").alias("_n")).agg(F.min("axis").alias("_a")))
        labs = labs.join(ax, labs.lbl == ax._n, "left")
        axis = F.coalesce(F.col("_a"), F.lit(default_axis))
    else:
        axis = F.lit(default_axis)
    return labs.groupBy(axis.alias("label_key")).agg(F.array_sort(F.collect_set("lbl")).alias("label"))


def promote_columns(nodes: DataFrame, wide: DataFrame, key: str = "NODE",
                    columns: list | None = None, order_by: list | None = None):
    """Copy whole wide-source columns onto EXISTING nodes by key.

    Never creates nodes; null cells are skipped (the node keeps its value);
    rows with a null key or only null cells do nothing; column names are
    kept verbatim; re-running gives the same result. Duplicate wide keys:
    last row wins (``order_by``, then the row's values).

    Returns (new_nodes, stats) where stats has nodes_matched, properties_set.
    """
    from .hydrate import dedupe_last
    cols = [c for c in (columns or [c for c in wide.columns if c != key]) if c != key]
    w = wide.select(F.col(f"`{key}`").cast("string").alias("_k"),
                    *[F.col(f"`{c}`").alias(c) for c in cols], *[F.col(o) for o in (order_by or []) if o not in cols])
    w = w.filter(F.col("_k").isNotNull())
    nonnull = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in cols), F.lit(0))
    w = w.filter(nonnull > 0)
    w = dedupe_last(w, "_k", order_by).select("_k", *[F.col(f"`{c}`") for c in cols])
    w = w.join(nodes.select(F.col(f"`{key}`").alias("_k")), "_k", "left_semi")
    stats = w.agg(F.count(F.lit(1)).alias("nodes_matched"),
                  F.coalesce(F.sum(sum((F.col(f"`{c}`").isNotNull().cast("long") for c in cols), F.lit(0))),
                             F.lit(0)).alias("properties_set"))
    wj = w.select("_k", *[F.col(f"`{c}`").alias(f"_p_{c}") for c in cols])
    j = nodes.join(wj, nodes[f"`{key}`"] == wj._k, "left")
    out = []
    for c in nodes.columns:
        if c in cols:
            out.append(F.coalesce(F.col(f"`_p_{c}`"), F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    out += [F.col(f"`_p_{c}`").alias(c) for c in cols if c not in nodes.columns]
    return j.select(*out), stats
