"""Graph build: tables -> property graph.

Node and edge specs are projected, unioned and MERGEd per element kind. "Last
wins" needs an order that Spark rows do not have, so every row carries ``_seq =
struct(spec index, the spec's order columns, the row's own values)`` and the
merge is ``max_by(..., _seq)``: deterministic, shuffle-once, partial-aggregated
map side.

Whole rows move only where they must. Two narrow jobs run while the plan is
made: the 64-bit hashes of the keys tell which keys are repeated (the other
rows are not merged), and the distinct ends of edges tell which of them are no
nodes (most builds have none, and then no edge is joined with a node).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import splittable_join
from ..functions.labels import SAFE_IDENT_PATTERN, is_safe_ident
from ..graph import PropertyGraph
from ..session import pinned


def _frame(spark: SparkSession, source) -> DataFrame:
    return spark.sql(source) if isinstance(source, str) else source


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class NodeSpec:
    """One node SELECT: id column, a constant label or a label column,
    property columns, facet columns (extra labels, with their axis) and
    optional order columns that define "last" among duplicate ids."""
    source: object                      # DataFrame or SQL text
    id: str
    label: str | None = None
    label_column: str | None = None
    properties: list = field(default_factory=list)
    facets: dict = field(default_factory=dict)     # column -> axis
    order_by: list = field(default_factory=list)


@dataclass
class EdgeSpec:
    source: object
    id: str
    source_key: str
    target_key: str
    type: str | None = None
    type_column: str | None = None
    properties: list = field(default_factory=list)
    order_by: list = field(default_factory=list)


def _label_col(spec_label, spec_col) -> Column:
    if spec_col:
        return F.col(_q(spec_col)).cast("string")
    return F.lit(spec_label).cast("string")


def _node_rows(spark: SparkSession, specs: list[NodeSpec]) -> DataFrame:
    """Union of the projected node rows of all specs (no merge yet)."""
    parts = []
    for i, s in enumerate(specs):
        df = _frame(spark, s.source)
        cols = [F.col(_q(s.id)).cast("string").alias("NODE"),
                F.lit(i).alias("_spec"),
                _label_col(s.label, s.label_column).alias("_lbl"),
                F.array(*[F.col(_q(c)).cast("string") for c in s.facets]).alias("_facets")
                if s.facets else F.array().cast("array<string>").alias("_facets")]
        cols += [F.col(_q(o)).alias(f"_o{i}_{j}") for j, o in enumerate(s.order_by)]
        cols += [F.col(_q(p)).alias(p) for p in s.properties]
        parts.append(df.select(*cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _seq(df: DataFrame, value_cols: list[str]) -> Column:
    order_cols = sorted(c for c in df.columns if c.startswith("_o"))
    return F.struct(F.col("_spec"), *[F.col(c) for c in order_cols],
                    *[F.col(_q(c)) for c in value_cols])


#: Up to so many hashes of repeated keys are broadcast (8 MB); up to ``SIEVED`` times as many as bits of a table of so
#: many rows; beyond that all rows are merged.
REPEATED = 1 << 20
SIEVED = 16


def _split_repeated(rows: DataFrame, key: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows whose key occurs once, rows to be merged); None: no such rows.

    Only the keys' hashes (40 bits) are counted and moved. A hash that two keys
    share sends both to the merge, which leaves a single row as it is; so does a
    bit that two hashes share, where there are many."""
    h = F.xxhash64(*key).bitwiseAND(F.lit((1 << 40) - 1))
    repeated, n = pinned(rows.select(h.alias("_h")).groupBy("_h").count().filter("count > 1").select("_h"), "repeated")
    if n == 0:
        return rows, None
    if n > SIEVED * REPEATED:
        return None, rows
    if n <= REPEATED:
        small = F.broadcast(repeated)
        return rows.join(small, h == F.col("_h"), "left_anti"), rows.join(small, h == F.col("_h"), "left_semi")
    word = F.expr(f"pmod(_h, {REPEATED}L)")     # 64 bits a row, told apart by the hash's upper 6
    bits = repeated.groupBy(word.alias("_w")).agg(F.expr("bit_or(shiftleft(1L, int(shiftright(_h, 34))))").alias("_bits"))
    sieved = rows.withColumn("_h", h).join(F.broadcast(bits), word == F.col("_w"), "left")
    hit = F.expr("coalesce(shiftright(_bits, int(shiftright(_h, 34))) & 1L, 0L) = 1L")
    return sieved.filter(~hit).select(*rows.columns), sieved.filter(hit).select(*rows.columns)


def _missing_ends(rows: list[DataFrame], nodes: DataFrame) -> DataFrame | None:
    """The ends of edges that are no nodes (column ``end``); None if there are none."""
    ends = None
    for df in rows:
        for c in ("src", "dst"):
            e = df.select(F.col(c).alias("end"))
            ends = e if ends is None else ends.unionByName(e)
    # A pruned scan looks small to the planner: both sides are shuffled, the ids never broadcast.
    ids = nodes.select("NODE").filter(F.col("NODE").isNotNull()).hint("merge")
    missing, n = pinned(ends.distinct().join(ids, F.col("end") == F.col("NODE"), "left_anti"), "missing-ends")
    return missing if n else None


def build_nodes(spark: SparkSession, specs: list[NodeSpec],
                keep_first_label: bool = False) -> DataFrame:
    """B1: MERGE node rows by NODE.

    Null ids are dropped. The label SET accumulates over all rows/specs;
    ``LABEL`` is the last label; each property is its last non-null value.
    ``labels`` = [LABEL] + the other labels sorted. Ids that occur once pass
    through; only repeated ids are merged in order.
    """
    rows = _node_rows(spark, specs).filter(F.col("NODE").isNotNull())
    props = [c for c in rows.columns
             if c not in ("NODE", "_spec", "_lbl", "_facets") and not c.startswith("_o")]
    once, many = _split_repeated(rows, ["NODE"])
    extra = ["_first_label"] if keep_first_label else []
    vector = F.concat(F.array("_lbl"), F.col("_facets"))
    parts = []
    if once is not None:
        parts.append(once.select("NODE", F.col("_lbl").alias("LABEL"), F.array_distinct(vector).alias("_all"),
                                 *[F.col("_lbl").alias(c) for c in extra], *[F.col(_q(p)) for p in props]))
    if many is not None:
        parts.append(_merge_nodes(many, vector, props, keep_first_label))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    labels = F.concat(F.array("LABEL"),
                      F.array_sort(F.filter(F.array_except("_all", F.array("LABEL")),
                                            lambda x: x.isNotNull())))
    return merged.select("NODE", "LABEL", labels.alias("labels"),
                         *[F.col(_q(p)) for p in props], *extra)


def _merge_nodes(many: DataFrame, vector: Column, props: list[str], keep_first_label: bool) -> DataFrame:
    many = many.withColumn("_seq", _seq(many, ["_lbl"] + props))
    aggs = [F.max_by("_lbl", "_seq").alias("LABEL"),
            # collect_set: a hot id keeps one entry per distinct label vector.
            F.array_distinct(F.flatten(F.collect_set(vector))).alias("_all")]
    if keep_first_label:
        aggs.append(F.min_by("_lbl", "_seq").alias("_first_label"))
    for p in props:
        aggs.append(F.expr(f"max_by({_q(p)}, _seq) FILTER (WHERE {_q(p)} IS NOT NULL)").alias(p))
    return many.groupBy("NODE").agg(*aggs)


def _edge_rows(spark: SparkSession, specs: list[EdgeSpec]) -> DataFrame:
    parts = []
    for i, s in enumerate(specs):
        df = _frame(spark, s.source)
        cols = [F.col(_q(s.id)).cast("string").alias("ID"),
                F.col(_q(s.source_key)).cast("string").alias("src"),
                F.col(_q(s.target_key)).cast("string").alias("dst"),
                _label_col(s.type, s.type_column).alias("type"),
                F.lit(i).alias("_spec")]
        cols += [F.col(_q(o)).alias(f"_o{i}_{j}") for j, o in enumerate(s.order_by)]
        cols += [F.col(_q(p)).alias(p) for p in s.properties]
        parts.append(df.select(*cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _merge_edge_rows(rows: DataFrame) -> DataFrame:
    key = ["src", "dst", "type", "ID"]
    props = [c for c in rows.columns if c not in (*key, "_spec") and not c.startswith("_o")]
    cols = [*key, *[F.col(_q(p)) for p in props]]
    once, many = _split_repeated(rows, key)
    parts = [once.select(*cols)] if once is not None else []
    if many is not None and not props:
        # Property-less specs: the merge is a plain distinct (hash aggregate).
        parts.append(many.select(*key).distinct())
    elif many is not None:
        many = many.withColumn("_seq", _seq(many, props))
        aggs = [F.expr(f"max_by({_q(p)}, _seq) FILTER (WHERE {_q(p)} IS NOT NULL)").alias(p) for p in props]
        parts.append(many.groupBy(*key).agg(*aggs).select(*cols))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def build_edges(spark: SparkSession, specs: list[EdgeSpec], nodes: DataFrame) -> DataFrame:
    """B2: edges whose id/src/dst are non-null and whose BOTH endpoints are
    nodes; MERGE identity (src, dst, type, ID); properties last non-null.

    Specs without properties are merged with a hash ``distinct``; only specs
    with properties pay for the ordered ``max_by`` merge, and both only for
    repeated edges. An edge id produced by both kinds keeps the properties of
    the property-carrying rows (a property-less row never erases a value);
    kinds whose types cannot meet are not compared. Edges are joined with the
    ends that are no nodes, if there are any, not with the nodes.
    """
    def whole(ss):
        return _edge_rows(spark, ss).filter(F.col("ID").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())

    with_p = [s for s in specs if s.properties]
    without_p = [s for s in specs if not s.properties]
    key = ["src", "dst", "type", "ID"]
    rows = {kind: whole(ss) for kind, ss in (("with", with_p), ("without", without_p)) if ss}
    missing = _missing_ends(list(rows.values()), nodes)
    if missing is not None:
        for kind in rows:
            for end in ("src", "dst"):
                rows[kind] = splittable_join(rows[kind], missing.select(F.col("end").alias(end)), [end], "left_anti")
    parts = [_merge_edge_rows(rows["with"])] if with_p else []
    if without_p:
        plain = _merge_edge_rows(rows["without"])
        fixed = lambda ss: {s.type for s in ss} if all(s.type_column is None for s in ss) else None
        a, b = fixed(with_p), fixed(without_p)
        if parts and (a is None or b is None or a & b):
            plain = plain.join(parts[0].select(*key), key, "left_anti")
        parts.append(plain)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    props = [c for c in out.columns if c not in key]
    return out.select("ID", "src", "dst", "type", *[F.col(_q(p)) for p in props])


def build_graph(spark: SparkSession, node_specs: list[NodeSpec], edge_specs: list[EdgeSpec],
                name: str = "graph") -> PropertyGraph:
    nodes = build_nodes(spark, node_specs)
    edges = build_edges(spark, edge_specs, nodes)
    return PropertyGraph(nodes, edges, name=name)


def build_counts(spark: SparkSession, node_specs: list[NodeSpec],
                 edge_specs: list[EdgeSpec]) -> DataFrame:
    """Nodes created per label (a duplicate id counts for the label that
    first created it) and edges created per type. Columns kind, name, n."""
    nodes = build_nodes(spark, node_specs, keep_first_label=True)
    edges = build_edges(spark, edge_specs, nodes)
    n = (nodes.groupBy(F.col("_first_label").alias("name")).count()
         .select(F.lit("node").alias("kind"), "name", F.col("count").alias("n")))
    e = (edges.groupBy(F.col("type").alias("name")).count()
         .select(F.lit("edge").alias("kind"), "name", F.col("count").alias("n")))
    return n.unionByName(e)


def dropped_rows_report(spark: SparkSession, node_specs: list[NodeSpec],
                        edge_specs: list[EdgeSpec]) -> DataFrame:
    """Rows the build discards, by reason. Columns kind, reason, n.

    node: null_id, duplicate (rows merged into an existing id);
    edge: null_id_or_endpoint, missing_endpoint, duplicate.
    Each side is one aggregation over flagged rows (endpoint existence by
    two left joins to the distinct node ids); no cross joins.
    """
    nrows = _node_rows(spark, node_specs).select("NODE")
    nstats = nrows.agg(F.sum(F.col("NODE").isNull().cast("long")).alias("null_id"),
                       (F.count("NODE") - F.count_distinct("NODE")).alias("duplicate"))
    node_rep = nstats.select(F.stack(F.lit(2), F.lit("null_id"), F.col("null_id"),
                                     F.lit("duplicate"), F.col("duplicate")).alias("reason", "n"))
    ids = nrows.filter(F.col("NODE").isNotNull()).distinct()
    erows = _edge_rows(spark, edge_specs).select("ID", "src", "dst", "type")
    good = F.col("ID").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()
    flagged = splittable_join(erows.withColumn("_good", good), ids.select(F.col("NODE").alias("src"), F.lit(True).alias("_hs")), ["src"], "left")
    flagged = splittable_join(flagged, ids.select(F.col("NODE").alias("dst"), F.lit(True).alias("_hd")), ["dst"], "left")
    kept = F.col("_good") & F.col("_hs").isNotNull() & F.col("_hd").isNotNull()
    estats = flagged.agg(
        F.sum((~F.col("_good")).cast("long")).alias("bad"),
        F.sum((F.col("_good") & ~kept).cast("long")).alias("missing"),
        (F.sum(kept.cast("long")) - F.count_distinct(F.when(kept, F.struct("src", "dst", "type", "ID"))))
        .alias("dup"))
    edge_rep = estats.select(F.stack(
        F.lit(3), F.lit("null_id_or_endpoint"), F.col("bad"), F.lit("missing_endpoint"), F.col("missing"),
        F.lit("duplicate"), F.col("dup")).alias("reason", "n"))
    return (node_rep.select(F.lit("node").alias("kind"), "reason", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
            .unionByName(edge_rep.select(F.lit("edge").alias("kind"), "reason",
                                         F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))))


def check_identifiers(spark: SparkSession, node_specs: list[NodeSpec],
                      edge_specs: list[EdgeSpec], raise_on_violation: bool = False) -> DataFrame:
    """Labels / types / property keys must match ``^[A-Za-z0-9_]+$``.

    Returns the violations (kind, value, n); with ``raise_on_violation`` a
    non-empty result aborts (the only action here is a bounded ``take(1)``).
    """
    import re
    rx = re.compile(SAFE_IDENT_PATTERN)
    parts = []
    for i, s in enumerate(node_specs):
        lbl = _label_col(s.label, s.label_column)
        parts.append(_frame(spark, s.source).select(F.lit("node_label").alias("kind"), lbl.alias("value")))
    for i, s in enumerate(edge_specs):
        t = _label_col(s.type, s.type_column)
        parts.append(_frame(spark, s.source).select(F.lit("edge_type").alias("kind"), t.alias("value")))
    keys = sorted({p for s in list(node_specs) + list(edge_specs) for p in s.properties})
    bad_keys = [k for k in keys if not rx.match(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    viol = (out.filter(~is_safe_ident("value"))
            .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))
    if bad_keys:
        viol = viol.unionByName(spark.createDataFrame(
            [("property_key", k, 1) for k in bad_keys], "kind string, value string, n long"))
    if raise_on_violation and viol.take(1):
        raise ValueError("identifier check failed: unsafe label/type/key values")
    return viol


def create_graph_sql(spark: SparkSession, nodes_sql: list, edges_sql: list,
                     name: str = "graph") -> PropertyGraph:
    """Graph from SELECTs with the column contract NODE, LABEL (nodes)
    and NODE1, NODE2, LABEL (edges); other columns are attributes; ``name``
    is exposed as ``entity_name``. Edge id = ``NODE1->NODE2|LABEL`` unless an
    ``ID`` column is given."""
    def union(frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out
    n = union([_frame(spark, s) for s in nodes_sql])
    if "name" in n.columns:
        n = n.withColumnRenamed("name", "entity_name")
    n = n.withColumn("labels", F.array(F.col("LABEL").cast("string")))
    e = union([_frame(spark, s) for s in edges_sql])
    e = e.withColumnRenamed("NODE1", "src").withColumnRenamed("NODE2", "dst") \
         .withColumnRenamed("LABEL", "type")
    if "ID" not in e.columns:
        e = e.withColumn("ID", F.concat_ws("", "src", F.lit("->"), "dst", F.lit("|"), "type"))
    front = ["ID", "src", "dst", "type"]
    e = e.select(*front, *[F.col(_q(c)) for c in e.columns if c not in front])
    nfront = ["NODE", "LABEL", "labels"]
    n = n.select(*nfront, *[F.col(_q(c)) for c in n.columns if c not in nfront])
    return PropertyGraph(n, e, name=name)


def creation_ledger_latest(recipes: DataFrame, graph: str | None = None) -> DataFrame:
    """Recipes keyed (graph, engine), latest ``ts`` wins; spec JSON parsed
    (bad JSON -> null). Columns graph, engine, statement, source, ts, spec."""
    df = recipes if graph is None else recipes.filter(F.col("graph") == graph)
    latest = df.groupBy("graph", "engine").agg(
        F.max_by(F.struct("statement", "source", "ts", "spec_json"),
                 F.struct("ts", "statement", "source", "spec_json")).alias("r"))
    return latest.select("graph", "engine", "r.statement", "r.source", "r.ts",
                         F.try_parse_json(F.col("r.spec_json")).alias("spec"))
