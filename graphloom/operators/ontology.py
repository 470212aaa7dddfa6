"""Ontology and schema summaries: aggregations only.

Every summary is a partial + final hash aggregation over nodes or edges;
joins to the ontology use its (bounded) distinct label rows, which AQE
broadcasts when they are measured small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import DEFAULT_EDGE_AXIS, DEFAULT_NODE_AXIS, SAFE_IDENT_PATTERN, structural_label
from ..functions.frames import counts_row
from ..graph import NODE_META, PropertyGraph


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def schema_labels(nodes: DataFrame) -> DataFrame:
    """distinct labels (arrays flattened)."""
    return nodes.select(F.explode("labels").alias("label")).distinct()


def label_counts(nodes: DataFrame) -> DataFrame:
    """count and percent per STRUCTURAL (first) label; the denominator
    counts ALL nodes, unlabeled ones included. One aggregation pass for the
    groups; the total is the sum of the groups (incl. the null group)."""
    grp = nodes.groupBy(structural_label("labels").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # The total is summed over the grouped rows (one per label: schema-sized).
    tot = F.sum("n").over(Window.partitionBy())
    return (grp.select("label", "n", tot.alias("_tot")).filter(F.col("label").isNotNull())
            .select("label", "n", F.round(F.col("n") * 100.0 / F.col("_tot"), 2).alias("pct")))


def rel_counts(edges: DataFrame) -> DataFrame:
    """edge count and percent per type."""
    grp = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())
    return grp.select("type", "n", F.round(F.col("n") * 100.0 / tot, 2).alias("pct"))


def _struct_labels(g: PropertyGraph) -> DataFrame:
    return g.nodes.select("NODE", structural_label("labels").alias("l0"))


def schema_triples(g: PropertyGraph) -> DataFrame:
    """distinct (structural src label, type, structural dst label).

    The source label is attached first and the rows are reduced to distinct
    (src_label, type, dst) BEFORE the destination join: edges into a hub
    node (a nation, a region) collapse map-side to one row per source label,
    so the second join is not skewed by the hub."""
    lab = _struct_labels(g).filter(F.col("l0").isNotNull())
    e = g.edges.select("src", "type", "dst")
    s = lab.select(F.col("NODE").alias("src"), F.col("l0").alias("src_label"))
    d = lab.select(F.col("NODE").alias("dst"), F.col("l0").alias("dst_label"))
    half = e.join(s, "src").select("src_label", "type", "dst").distinct()
    return half.join(d, "dst").select("src_label", "type", "dst_label").distinct()


def label_properties(g: PropertyGraph, sample: bool = False) -> DataFrame:
    """property keys per structural label (a key counts where non-null).

    ``sample=True`` mimics the one-node-per-label view: keys of the node with
    the smallest id per label."""
    props = [c for c in g.nodes.columns if c not in NODE_META]
    present = F.filter(F.array(*[F.when(F.col(_q(p)).isNotNull(), F.lit(p)) for p in props]),
                       lambda x: x.isNotNull())
    base = g.nodes.select(structural_label("labels").alias("label"), "NODE", present.alias("keys"))
    # Labels that are not safe identifiers are skipped, as in the reference.
    base = base.filter(F.col("label").isNotNull() & F.col("label").rlike(SAFE_IDENT_PATTERN))
    if sample:
        return base.groupBy("label").agg(F.array_sort(F.min_by("keys", "NODE")).alias("keys"))
    return (base.select("label", F.explode("keys").alias("k")).groupBy("label")
            .agg(F.array_sort(F.collect_set("k")).alias("keys")))


def graph_counts(g: PropertyGraph) -> DataFrame:
    """total nodes and edges (two aggregations, one row)."""
    return counts_row([("nodes", g.nodes), ("edges", g.edges)])


def _axis_of(onto: DataFrame | None, kind: str) -> DataFrame | None:
    if onto is None:
        return None
    return (onto.filter(F.col("type_kind") == kind)
            .groupBy(F.col("type_name").alias("_name")).agg(F.min("axis").alias("_axis")))


def schema_axes(nodes: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """F8: axis -> sorted labels; a label without ontology row -> EntityType."""
    labs = schema_labels(nodes)
    ax = _axis_of(onto, "entity")
    if ax is not None:
        labs = labs.join(ax, labs.label == ax._name, "left")
        axis = F.coalesce(F.col("_axis"), F.lit(DEFAULT_NODE_AXIS))
    else:
        axis = F.lit(DEFAULT_NODE_AXIS)
    return labs.groupBy(axis.alias("axis")).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def rel_axes(edges: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """axis -> relation types (RelationType default)."""
    types = edges.select("type").distinct()
    ax = _axis_of(onto, "relation")
    if ax is not None:
        types = types.join(ax, types.type == ax._name, "left")
        axis = F.coalesce(F.col("_axis"), F.lit(DEFAULT_EDGE_AXIS))
    else:
        axis = F.lit(DEFAULT_EDGE_AXIS)
    return types.groupBy(axis.alias("axis")).agg(F.array_sort(F.collect_set("type")).alias("types"))


def label_distribution(g: PropertyGraph) -> DataFrame:
    """counts per label VECTOR (nodes) and per type (edges), plus
    labeled / unlabeled totals obtained by summing the groups."""
    n = g.nodes.groupBy("labels").agg(F.count(F.lit(1)).alias("n"))
    e = g.edges.groupBy(F.array("type").alias("labels")).agg(F.count(F.lit(1)).alias("n"))
    nt = (n.groupBy(F.when(F.size("labels") > 0, "labeled").otherwise("unlabeled").alias("t"))
          .agg(F.sum("n").alias("n")).select(F.lit("node_total").alias("kind"), F.array("t").alias("labels"), "n"))
    et = e.agg(F.sum("n").alias("n")).select(F.lit("edge_total").alias("kind"),
                                            F.array(F.lit("labeled")).alias("labels"), "n")
    return (n.select(F.lit("node").alias("kind"), "labels", "n")
            .unionByName(e.select(F.lit("edge").alias("kind"), "labels", "n"))
            .unionByName(nt).unionByName(et))


def label_distribution_json(df: DataFrame, col: str) -> DataFrame:
    """F10 (JSON form): a column of JSON ``[{labels:[...], count:n}, ...]``
    documents -> per label vector counts; bad JSON contributes zero rows."""
    parsed = F.from_json(F.col(col), "array<struct<labels:array<string>,count:bigint>>")
    ex = df.select(F.explode_outer(parsed).alias("x")).filter(F.col("x").isNotNull())
    return ex.groupBy(F.col("x.labels").alias("labels")).agg(F.sum("x.count").alias("n"))


def schema_by_axis(g: PropertyGraph, onto: DataFrame | None = None) -> DataFrame:
    """schema triples at label grain (``full``), with node labels
    replaced by their axis (``nkey``: axis of the node's last facet label,
    EntityType default) and with edge types replaced by their axis (``ekey``)."""
    n = g.nodes.filter(F.size("labels") > 0).select(
        "NODE", structural_label("labels").alias("l0"), F.try_element_at("labels", F.lit(-1)).alias("lz"))
    ax = _axis_of(onto, "entity")
    if ax is not None:
        n = n.join(ax, n.lz == ax._name, "left").withColumn(
            "axis", F.coalesce(F.col("_axis"), F.lit(DEFAULT_NODE_AXIS)))
    else:
        n = n.withColumn("axis", F.lit(DEFAULT_NODE_AXIS))
    n = n.select("NODE", "l0", "axis")
    rax = _axis_of(onto, "relation")
    e = g.edges.select("src", "dst", "type")
    if rax is not None:
        e = e.join(rax, e.type == rax._name, "left").withColumn(
            "taxis", F.coalesce(F.col("_axis"), F.lit(DEFAULT_EDGE_AXIS))).drop("_name", "_axis")
    else:
        e = e.withColumn("taxis", F.lit(DEFAULT_EDGE_AXIS))
    s = n.select(F.col("NODE").alias("src"), F.col("l0").alias("s_l"), F.col("axis").alias("s_a"))
    d = n.select(F.col("NODE").alias("dst"), F.col("l0").alias("d_l"), F.col("axis").alias("d_a"))
    # As in schema_triples, edges into a hub collapse before the second join. The
    # nodes are never broadcast, however small two of their columns look to the planner.
    half = e.join(s.hint("merge"), "src").select("s_l", "s_a", "type", "taxis", "dst").distinct()
    t = half.join(d.hint("merge"), "dst").select("s_l", "s_a", "type", "taxis", "d_l", "d_a").distinct()
    return (t.select(F.lit("full").alias("mode"), F.col("s_l").alias("src"), "type", F.col("d_l").alias("dst"))
            .unionByName(t.select(F.lit("nkey").alias("mode"), F.col("s_a").alias("src"), "type",
                                  F.col("d_a").alias("dst")))
            .unionByName(t.select(F.lit("ekey").alias("mode"), F.col("s_l").alias("src"),
                                  F.col("taxis").alias("type"), F.col("d_l").alias("dst")))
            .distinct())
