"""Pattern matching as join chains.

A pattern is an alternating list ``[N, E, N, E, N ...]``. Each node alias and
edge alias becomes one struct column of the result carrying only the fields
asked for (``NODE``/``LABEL`` and ``props`` for nodes; ``ID``/``src``/``dst``/
``type`` and ``props`` for edges), so the join chain moves narrow rows.
Predicates are applied to the node/edge frames BEFORE the join that brings
them in; edge type filters are partition filters on a stored graph.

Join strategy is left to Catalyst + AQE: a side that turns out small at run
time is broadcast (bounded by ``spark.sql.autoBroadcastJoinThreshold``),
otherwise both sides shuffle on the hop key; on a bucketed graph
(:func:`graphloom.sources.store.read_bucketed`) scans already lie by these keys,
and a hop from scanned nodes, or to them, has no shuffle on that side. Where the
chain begins is chosen from the stored statistics (:func:`choose_start`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import display_label
from ..graph import PropertyGraph


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class N:
    alias: str
    label: str | None = None
    where: Column | None = None
    props: list = field(default_factory=list)


@dataclass
class E:
    alias: str | None = None
    type: object = None            # str, list of str or None (any type)
    direction: str = "->"          # "->", "<-" or "-" (undirected)
    where: Column | None = None
    props: list = field(default_factory=list)

    def types(self) -> list | None:
        if self.type is None:
            return None
        return [self.type] if isinstance(self.type, str) else list(self.type)


def node_frame(g: PropertyGraph, n: N, extra: list | None = None, slim: bool = False) -> DataFrame:
    """Nodes that fit: their id and their struct, ``slim``: without the id."""
    df = g.nodes
    if n.label is not None:
        df = df.filter(F.array_contains("labels", n.label))
    if n.where is not None:
        df = df.filter(n.where)
    fields = ["LABEL"] + [p for p in list(n.props) + list(extra or []) if p not in ("NODE", "LABEL")]
    fields = fields if slim else ["NODE"] + fields
    return df.select(F.col("NODE").alias("_nk"),
                     F.struct(*[F.col(_q(f)).alias(f) for f in fields]).alias(n.alias))


def edge_frame(g: PropertyGraph, e: E, alias: str, slim: bool = False) -> DataFrame:
    """Edges oriented for the hop: ``_near`` is the end at the previous node.
    A graph stored by both ends is read from the copy that lies by ``_near``.
    ``slim``: the struct lacks what the ends and the pattern tell (:func:`_edge_fields`)."""
    t = e.types()

    def fitting(df: DataFrame) -> DataFrame:
        if t is not None:
            df = df.filter(F.col("type").isin(t))
        return df if e.where is None else df.filter(e.where)

    df, by_dst = fitting(g.edges), fitting(g.meta["by_dst"]) if "by_dst" in g.meta else None
    by_dst = df if by_dst is None else by_dst
    fields = ["ID"] + (["src", "dst", "type"] if not slim else [] if _one_type(e) else ["type"])
    fields += [p for p in e.props if p not in ("ID", "src", "dst", "type")]
    cols = [F.col(_q(f)).alias(f) for f in fields]
    turned = slim and e.direction == "-"
    st = F.struct(*cols, *([F.lit(True).alias("_fwd")] if turned else [])).alias(alias)
    if e.direction == "->":
        return df.select(F.col("src").alias("_near"), F.col("dst").alias("_far"), st)
    if e.direction == "<-":
        return by_dst.select(F.col("dst").alias("_near"), F.col("src").alias("_far"), st)
    # Undirected: both orientations, a self-loop only once.
    fwd = df.select(F.col("src").alias("_near"), F.col("dst").alias("_far"), st)
    st = F.struct(*cols, *([F.lit(False).alias("_fwd")] if turned else [])).alias(alias)
    rev = (by_dst.filter(F.col("src") != F.col("dst"))
             .select(F.col("dst").alias("_near"), F.col("src").alias("_far"), st))
    return fwd.unionByName(rev)


EDGE_KEY = ["ID", "src", "dst", "type"]
_FLIP = {"->": "<-", "<-": "->", "-": "-"}


def _estimates(g: PropertyGraph, pattern: list) -> tuple | None:
    """(rows of node i, rows a path of hop i becomes, edges that fit hop i) by the stored counts; None: no statistics.

    A node keeps its label's count, and a tenth of it under a predicate (as planners assume without histograms); a hop
    multiplies by the type's mean degree at the near end, and by the share of nodes that fit at the far end (labels
    are taken to follow the type)."""
    stats = g.meta.get("stats")
    if stats is None:
        return None
    nodes, hops = pattern[0::2], pattern[1::2]
    total = max(stats["nodes"], 1)
    share = lambda x: 0.1 if x.where is not None else 1.0
    types = lambda e: [stats["types"].get(t, (0, 1, 1)) for t in (e.types() if e.types() is not None else stats["types"])]

    def fit(i: int) -> float:
        return (stats["labels"].get(nodes[i].label, 0) if nodes[i].label is not None else total) * share(nodes[i])

    def grow(i: int, back: bool) -> float:
        e, far = hops[i], nodes[i] if back else nodes[i + 1]
        direction = _FLIP[e.direction] if back else e.direction
        n = {d: sum(t[0] / max(t[k], 1) for t in types(e)) for k, d in ((1, "->"), (2, "<-"))}
        return (n["->"] + n["<-"] if direction == "-" else n[direction]) * share(e) * share(far)

    return fit, grow, lambda i: sum(t[0] for t in types(hops[i])) * share(hops[i])


def choose_start(g: PropertyGraph, pattern: list) -> int:
    """The node of a pattern from which the join chain makes the fewest rows,
    by the stored counts of labels, types and their distinct ends
    (:func:`_estimates`). Without statistics: 0."""
    known = _estimates(g, pattern)
    if known is None:
        return 0
    fit, grow, _ = known
    n_nodes = len(pattern[0::2])

    def cost(start: int) -> float:
        rows = fit(start)
        made = rows
        for i in range(start, n_nodes - 1):
            rows *= grow(i, False)
            made += rows
        for i in range(start, 0, -1):
            rows *= grow(i - 1, True)
            made += rows
        return made

    return min(range(n_nodes), key=lambda i: (cost(i), i))


def _leaf_first(g: PropertyGraph, pattern: list, start: int, leaf: int) -> bool:
    """Whether the last hop of a chain, to node ``leaf``, joins its edges with that node before the paths: if the
    statistics make the paths at least half as many as the edges. Edges that lie by their near end stay there."""
    known = _estimates(g, pattern)
    if known is None or "by_dst" in g.meta:
        return False
    fit, grow, fitting = known
    rows = fit(start)
    for i in range(start, leaf if leaf > start else len(pattern[0::2]) - 1):     # the right end is reached first
        rows *= grow(i, False)
    for i in range(start, leaf, -1):
        rows *= grow(i - 1, True)
    return 2 * rows >= fitting(leaf - 1 if leaf > start else leaf)


def _fields(n: N) -> list:
    """Fields of a node's struct beside its id."""
    return ["LABEL"] + [p for p in n.props if p not in ("NODE", "LABEL")]


def _one_type(e: E) -> bool:
    return e.types() is not None and len(e.types()) == 1


def _edge_fields(e: E, direction: str, alias: str, near: str, far: str) -> dict:
    """The fields of a joined slim edge as columns of its path."""
    st, near, far = F.col(_q(alias)), F.col(near), F.col(far)
    src, dst = (near, far) if direction == "->" else (far, near)
    if direction == "-":
        src, dst = F.when(st["_fwd"], near).otherwise(far), F.when(st["_fwd"], far).otherwise(near)
    return {"ID": st["ID"], "src": src, "dst": dst, "type": F.lit(e.types()[0]) if _one_type(e) else st["type"],
            **{p: st[p] for p in e.props if p not in EDGE_KEY}}


def match(g: PropertyGraph, pattern: list, where: Column | None = None,
          unique_edges: bool = True, keep_anonymous: bool = False, start: int | str | None = None) -> DataFrame:
    """Run a linear pattern; one row per match (path).

    An edge occurs at most once in a match; its identity is (src, dst, type,
    ID). A node whose alias starts with ``_`` and that has no label, predicate
    or property is anonymous: only its ``NODE`` is there, without a join.

    ``start`` (node position or alias) is where the join chain begins; it
    extends to the right end, then to the left end, so every join brings in one
    hop next to already-matched rows. The result is the same for any start; by
    default the statistics of the graph choose it (:func:`choose_start`).
    """
    if not pattern or not isinstance(pattern[0], N) or len(pattern) % 2 == 0:
        raise ValueError("pattern must alternate N, E, N, ... and start/end with N")
    nodes = pattern[0::2]
    if start is None:
        start = choose_start(g, pattern)
    if isinstance(start, str):
        start = [n.alias for n in nodes].index(start)
    if not 0 <= start < len(nodes):
        raise ValueError("start must name a node of the pattern")
    # Hops in join order: (anchor node, edge as seen from the anchor, new node).
    hops = []
    for i in range(start, len(nodes) - 1):
        e = pattern[2 * i + 1]
        hops.append((nodes[i], e, e.direction, nodes[i + 1], f"_e{i}"))
    for i in range(start, 0, -1):
        e = pattern[2 * i - 1]
        hops.append((nodes[i], e, _FLIP[e.direction], nodes[i - 1], f"_e{i - 1}"))
    # A path carries each id once: node ids are plain columns (a scan's partitioning is known by them), edges carry
    # their other fields, and the structs of nodes and edges are made at the end, with the edges' ends from the ids.
    at = {n.alias: f"_k{i}" for i, n in enumerate(nodes)}
    cur = node_frame(g, nodes[start], slim=True).withColumnRenamed("_nk", at[nodes[start].alias])
    edges: list[tuple[str, E, dict]] = []
    for i, (anchor, e, direction, n, auto) in enumerate(hops):
        ea = e.alias or auto
        near, far = at[anchor.alias], at[n.alias]
        # An anonymous node is only its id: edges end at nodes, no join is needed.
        anonymous = n.alias.startswith("_") and n.label is None and n.where is None and not n.props
        ed = edge_frame(g, E(e.alias, e.type, direction, e.where, e.props), ea, slim=True)
        nd = node_frame(g, n, slim=True)
        leaf = len(nodes) - 1 if i < len(nodes) - 1 - start else 0
        first = not anonymous and n is nodes[leaf] and anchor is not nodes[start] and _leaf_first(g, pattern, start, leaf)
        if first:       # an edge is narrower than a path: it moves to its far node before it joins
            ed = ed.join(nd, F.col("_far") == F.col("_nk")).drop("_far").withColumnRenamed("_nk", "_far")
        cur = cur.join(ed, F.col(near) == F.col("_near")).drop("_near").withColumnRenamed("_far", far)
        fields = _edge_fields(e, direction, ea, near, far)
        # Relationship uniqueness (an edge at most once per match) between
        # hops whose type sets can overlap.
        if unique_edges:
            for _, oe, other in edges:
                ta, tb = oe.types(), e.types()
                if ta is None or tb is None or set(ta) & set(tb):
                    same = [other[k].eqNullSafe(fields[k]) for k in EDGE_KEY]
                    cur = cur.filter(~(same[0] & same[1] & same[2] & same[3]))
        edges.append((ea, e, fields))
        if not anonymous and not first:
            cur = cur.join(nd, F.col(far) == F.col("_nk")).drop(far).withColumnRenamed("_nk", far)
    known = {n.alias: n for n in nodes}
    done = {}
    for alias, k in at.items():
        others = _fields(known[alias]) if alias in cur.columns else []
        done[alias] = F.struct(F.col(k).alias("NODE"), *[F.col(_q(alias))[f].alias(f) for f in others]).alias(alias)
    for ea, _, fields in edges:
        done[ea] = F.struct(*[c.alias(k) for k, c in fields.items()]).alias(ea)
    order = [nodes[start].alias] + [x for (_, e, _, n, auto) in hops for x in (e.alias or auto, n.alias)]
    cur = cur.select(*[done[x] for x in order])
    edge_aliases = [(ea, e) for ea, e, _ in edges]
    if where is not None:
        cur = cur.filter(where)
    if not keep_anonymous:
        cur = cur.drop(*[a for a, _ in edge_aliases if a.startswith("_e")])
    return cur


def match_nodes(g: PropertyGraph, label: str | None = None, where: Column | None = None,
                props: list | None = None) -> DataFrame:
    """``(n:label)`` scan with scalar projection."""
    df = g.nodes
    if label is not None:
        df = df.filter(F.array_contains("labels", label))
    if where is not None:
        df = df.filter(where)
    return df.select("NODE", "LABEL", *[F.col(_q(p)) for p in (props or [])])


def name_matches(query: str, name_col: str = "name") -> Column:
    """Case-insensitive substring on name, else NODE."""
    return F.lower(F.coalesce(F.col(name_col), F.col("NODE"))).contains(query.lower())


def not_exists(g: PropertyGraph, n: N, rest: list) -> DataFrame:
    """Nodes matching ``n`` with NO match of ``[n] + rest`` (left anti)."""
    base = node_frame(g, n)
    hits = match(g, [N(n.alias, n.label, n.where)] + rest).select(
        F.col(f"{n.alias}.NODE").alias("_nk"))
    return base.join(hits, "_nk", "left_anti").drop("_nk")


def path_value(nodes: list[str], edges: list[str]) -> Column:
    """The path of a match as struct(nodes: array, edges: array)."""
    return F.struct(
        F.array(*[F.struct(F.col(f"{a}.NODE").alias("NODE"), F.col(f"{a}.LABEL").alias("LABEL"))
                  for a in nodes]).alias("nodes"),
        F.array(*[F.struct(F.col(f"{a}.ID").alias("ID"), F.col(f"{a}.src").alias("src"),
                           F.col(f"{a}.dst").alias("dst"), F.col(f"{a}.type").alias("type"))
                  for a in edges]).alias("edges"))


def result_subgraph(result: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and edges appearing in any graph-typed cell.

    Graph-typed columns are found from the schema: a struct with ``NODE``
    (node), a struct with ``ID``/``src``/``dst`` (edge) or a path struct
    ``{nodes, edges}``. Node id = NODE; label = LABEL else first label that is
    not Entity. Returns (nodes[id, label], edges[id, src, dst, type]).
    """
    from pyspark.sql.types import ArrayType, StructType
    text = lambda c=None: (F.lit(None) if c is None else c).cast("string")

    def node(x: Column, names: set) -> Column:
        label = x["LABEL"] if "LABEL" in names else display_label(x["labels"]) if "labels" in names else F.lit(None)
        return F.struct(F.lit(False).alias("edge"), text(x["NODE"]).alias("id"), text().alias("src"), text().alias("dst"), text(label).alias("label"))

    def edge(x: Column, names: set) -> Column:
        return F.struct(F.lit(True).alias("edge"), text(x["ID"]).alias("id"), text(x["src"]).alias("src"), text(x["dst"]).alias("dst"),
                        text(x["type"] if "type" in names else None).alias("label"))

    none = F.array().cast("array<struct<edge:boolean,id:string,src:string,dst:string,label:string>>")
    each = lambda c, t, f: F.coalesce(F.transform(c, lambda x: f(x, set(t.fieldNames()))), none)
    parts = []
    for f in result.schema.fields:
        dt = f.dataType
        c = F.col(_q(f.name))
        if isinstance(dt, StructType):
            names = set(dt.fieldNames())
            if {"nodes", "edges"} <= names:
                parts += [each(c[k], dt[k].dataType.elementType, make) for k, make in (("nodes", node), ("edges", edge))]
            elif "NODE" in names:
                parts.append(F.array(node(c, names)))
            elif {"ID", "src", "dst"} <= names:
                parts.append(F.array(edge(c, names)))
        elif isinstance(dt, ArrayType) and isinstance(dt.elementType, StructType):
            names = set(dt.elementType.fieldNames())
            if "NODE" in names:
                parts.append(each(c, dt.elementType, node))
            elif {"ID", "src", "dst"} <= names:
                parts.append(each(c, dt.elementType, edge))
    # A row is read once for all its elements. Which kind a group is, is known only behind the shuffle, so that the plans of
    # both results agree up to it and it is made once. Labels are keys: a minimum of texts would sort the rows before it.
    found = (result.select(F.explode(F.concat(none, *parts)).alias("x")).select("x.*").groupBy("edge", "id", "src", "dst", "label")
             .agg(F.max(F.when(F.col("edge"), 1)).alias("_e"), F.max(F.when(~F.col("edge"), 1)).alias("_n")))
    # Deterministic pick among duplicates: smallest label per id.
    nodes = found.filter(F.col("_n").isNotNull() & F.col("_e").isNull()).groupBy("id").agg(F.min("label").alias("label"))
    # An edge is its id, ends and type together: equal ids of different edges stay apart.
    edges = found.filter(F.col("_e").isNotNull() & F.col("_n").isNull()).select("id", "src", "dst", F.col("label").alias("type"))
    return nodes, edges


def hops_to_graph(hops: DataFrame, n_hops: int) -> tuple[DataFrame, DataFrame]:
    """Unpivot NODE1_HOP_n / NODE2_HOP_n / EDGE_LABELS_HOP_n columns.

    Nodes are distinct ids with the first label seen (hop, then row order
    given by ``_row`` if present, then side; the smallest among equals); edges
    are keyed ``src->dst|label``. Label cells may be JSON-array strings (the
    first entry is used). ``hops`` is evaluated once for both results.
    """
    from ..functions.labels import normalize_labels
    first = lambda c: F.try_element_at(normalize_labels(F.col(c)), F.lit(1))
    no_text = F.lit(None).cast("string")
    ranked = "_row" in hops.columns
    parts = []
    for h in range(1, n_hops + 1):
        src, dst = F.col(f"NODE1_HOP_{h}"), F.col(f"NODE2_HOP_{h}")
        for side, node in ((1, src), (2, dst)):
            lc = f"NODE{side}_LABELS_HOP_{h}"
            place = F.struct(F.lit(h).alias("h"), F.col("_row").alias("r"), F.lit(side).alias("s")) if ranked else F.lit(2 * h + side)
            parts.append(F.struct(node.alias("key"), (F.col(lc).cast("string") if lc in hops.columns else no_text).alias("cell"),
                                  place.alias("place"), F.lit(None).cast("long").alias("cut")))
        el = F.coalesce(first(f"EDGE_LABELS_HOP_{h}"), F.lit(""))
        # The ends are read from the id again: their lengths are kept, not the texts.
        cut = F.shiftleft(F.char_length(src).cast("long"), 32) + F.char_length(dst)
        parts.append(F.struct(F.concat(src, F.lit("->"), dst, F.lit("|"), el).alias("key"), no_text.alias("cell"),
                              F.lit(None).cast(hops.select(place.alias("p")).schema["p"].dataType).alias("place"), cut.alias("cut")))
    # A row is read once for all its elements; a node's label cells are parsed when they are few. Both results test both minima, which are known only behind the
    # shuffle, so that their plans agree up to it and it is made once.
    found = (hops.select(F.explode(F.array(*parts)).alias("x")).select("x.*").filter(F.col("key").isNotNull())
             .groupBy("key", "cell", F.col("cut").isNotNull().alias("edge")).agg(F.min("place").alias("place"), F.min("cut").alias("cut")))
    nodes = (found.filter(F.col("place").isNotNull() & F.col("cut").isNull()).select("key", first("cell").alias("label"), "place").groupBy(F.col("key").alias("id"))
             .agg(F.expr("min_by(label, struct(place, label)) FILTER (WHERE label IS NOT NULL)").alias("label")))
    n, m = F.shiftright("cut", 32).cast("int"), F.col("cut").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    edges = (found.filter(F.col("place").isNull() & F.col("cut").isNotNull())
             .select(F.col("key").alias("id"), F.substring("key", 1, n).alias("src"), F.substring("key", n + 3, m).alias("dst"),
                     F.nullif(F.substring("key", n + m + 4, F.char_length("key")), F.lit("")).alias("type")))
    return nodes, edges


def node_attrs(g: PropertyGraph, ids: DataFrame, id_col: str = "NODE") -> DataFrame:
    """Attribute rows for a set of ids (de-duplicated), metadata columns
    dropped. Semi join: the nodes side is never shuffled whole to one task."""
    from ..graph import NODE_META
    keep = [c for c in g.nodes.columns if c not in NODE_META]
    k = ids.select(F.col(_q(id_col)).cast("string").alias("NODE")).filter(F.col("NODE").isNotNull())
    return (g.nodes.join(k, "NODE", "left_semi")
            .select("NODE", *[F.col(_q(c)) for c in keep]))


def get_records(g: PropertyGraph, ids: DataFrame, id_col: str = "NODE") -> DataFrame:
    """D17 (batch form): id, label and all properties of each requested node."""
    k = ids.select(F.col(_q(id_col)).cast("string").alias("NODE")).distinct()
    return g.nodes.join(k, "NODE", "left_semi")


def get_record(g: PropertyGraph, node_id: str) -> DataFrame:
    """Full record of one node (empty frame if absent)."""
    return g.nodes.filter(F.col("NODE") == node_id)


def graph_table(result: DataFrame, returns: dict, view: str) -> DataFrame:
    """Expose a pattern's RETURN aliases as a relation for SQL.

    ``returns`` maps output alias -> column path (e.g. ``{"nation": "n.name"}``);
    outer SQL sees only those aliases. The view is lazy, so Catalyst
    optimises match + SQL as one plan.
    """
    t = result.select(*[F.col(path).alias(alias) for alias, path in returns.items()])
    t.createOrReplaceTempView(view)
    return t


def top_k(df: DataFrame, k: int, order: list) -> DataFrame:
    """ORDER BY ... LIMIT k (TakeOrderedAndProject: each partition keeps
    its own top k, the driver merges k x partitions rows). Break ties by id."""
    return df.orderBy(*order).limit(k)
