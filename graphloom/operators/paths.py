"""Counting the matches of a pattern without making them.

A match count is a sum of products along the pattern, so it can be carried
hop by hop: every node holds the number of partial matches that end at it
(and the sums of wanted properties over them); a hop joins that one row per
node to the edges, and groups by the far end. What is shuffled is bounded by
the edges of each hop, never by the paths, however large a hub is.

Matches must not use an edge twice. Hops whose type sets cannot meet need no
correction. For two neighbouring hops that can use the same edge, the
partial matches that do are counted edge by edge and subtracted. Other
overlaps (three or more hops, or hops apart) keep their part of the pattern
as joined paths, grouped by their ends at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import splittable_join
from ..graph import PropertyGraph
from .match import _FLIP, _q, E, EDGE_KEY, N, edge_frame, match, node_frame


def _meets(a: E, b: E) -> bool:
    ta, tb = a.types(), b.types()
    return ta is None or tb is None or bool(set(ta) & set(tb))


def _plain(n: N) -> bool:
    return n.label is None and n.where is None


def _runs(hops: list[E]) -> list[tuple[int, int]]:
    """Hops cut into the smallest runs (first, last) that overlap with no other run."""
    runs: list[tuple[int, int]] = []
    for i in range(len(hops)):
        first = min([i, *(j for j in range(i) if _meets(hops[j], hops[i]))])
        while runs and runs[-1][1] >= first:
            first = min(first, runs.pop()[0])
        runs.append((first, i))
    return runs


class _Side:
    """Messages along one side of a pattern: rows (_at, n, and for each value
    its sum and the number of matches that have it)."""

    def __init__(self, g: PropertyGraph, values: dict[str, tuple[str, Column | str]]):
        self.g, self.values = g, values
        self.sums = [c for v in values for c in (f"s_{v}", f"c_{v}")]

    def node(self, msg: DataFrame | None, n: N) -> DataFrame | None:
        """The message at node ``n``: nodes that do not fit go, its values join. None is
        one match at every node."""
        mine = {v: c for v, (alias, c) in self.values.items() if alias == n.alias}
        if _plain(n) and not mine:
            return msg
        df = self.g.nodes
        if n.label is not None:
            df = df.filter(F.array_contains("labels", n.label))
        if n.where is not None:
            df = df.filter(n.where)
        df = df.select(F.col("NODE").alias("_k"), *[(F.col(_q(c)) if isinstance(c, str) else c).alias(f"_v_{v}") for v, c in mine.items()])
        if msg is None:
            out = df.withColumnRenamed("_k", "_at").withColumn("n", F.lit(1).cast("long"))
            out = out.withColumns({c: F.lit(0) for c in self.sums}) if self.sums else out
        else:
            out = msg.join(df, F.col("_at") == F.col("_k")).drop("_k")
        for v in mine:
            has = F.col(f"_v_{v}").isNotNull()
            out = out.withColumns({f"s_{v}": F.coalesce(F.col(f"_v_{v}"), F.lit(0)) * F.col("n"), f"c_{v}": F.when(has, F.col("n")).otherwise(F.lit(0).cast("long"))})
        return out.select("_at", "n", *self.sums)

    def _carried(self, over: DataFrame, weight: Column | None = None) -> DataFrame:
        w = weight if weight is not None else F.lit(1)
        return over.groupBy(F.col("_far").alias("_at")).agg(*[F.sum(F.col(c) * w).alias(c) for c in ("n", *self.sums)])

    def hop(self, msg: DataFrame | None, steps: DataFrame, weight: str | None = None) -> DataFrame:
        """The message behind steps (_near, _far [, weight])."""
        if msg is None:
            over = steps.withColumns({"n": F.lit(1).cast("long"), **{c: F.lit(0) for c in self.sums}})
        else:
            over = splittable_join(steps.withColumnRenamed("_near", "_at"), msg, ["_at"], "inner")
        return self._carried(over, F.col(weight) if weight else None)


def _ends(e: E, name: str) -> list[tuple[Column, Column]]:
    """(near, far) of an edge row for every orientation of a hop."""
    src, dst = F.col(f"{name}.src"), F.col(f"{name}.dst")
    return {"->": [(src, dst)], "<-": [(dst, src)], "-": [(src, dst), (dst, src)]}[e.direction]


def _twice(g: PropertyGraph, a: E, b: E) -> DataFrame:
    """Steps over two hops that use the same edge: (_near, _mid, _far, w).

    An edge stored m times can stand for both hops in m * m ways."""
    def rows(e: E) -> DataFrame:
        df = g.edges if e.types() is None else g.edges.filter(F.col("type").isin(e.types()))
        return df if e.where is None else df.filter(e.where)

    m = rows(a).groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).alias("w"))
    if a.where is None and b.where is None:
        m = (m if b.types() is None else m.filter(F.col("type").isin(b.types()))).withColumn("w", F.col("w") * F.col("w"))
    else:
        other = rows(b).groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).alias("w2"))
        x, y = m.alias("x"), other.alias("y")
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in EDGE_KEY]
        m = x.join(y, same[0] & same[1] & same[2] & same[3]).select(*[F.col(f"x.{k}").alias(k) for k in EDGE_KEY], (F.col("w") * F.col("w2")).alias("w"))
    m = m.select(F.struct(*EDGE_KEY).alias("e"), "w")
    out = None
    for i, (near, mid) in enumerate(_ends(a, "e")):
        for j, (mid2, far) in enumerate(_ends(b, "e")):
            fits = mid == mid2
            if i or j:      # a self-loop has one orientation only
                fits = fits & (F.col("e.src") != F.col("e.dst"))
            part = m.filter(fits).select(near.alias("_near"), mid.alias("_mid"), far.alias("_far"), "w")
            out = part if out is None else out.unionByName(part)
    return out


def _toward(g: PropertyGraph, side: _Side, nodes: list[N], hops: list[E]) -> tuple[DataFrame | None, DataFrame | None]:
    """Messages along ``nodes[0]``, ``hops[0]``, ... up to the last node: that
    behind the last hop, and that before it (None: one match at every node).
    The last node's own condition is not applied."""
    msg, before = side.node(None, nodes[0]), None
    for first, last in _runs(hops):
        before = msg
        if last == first:
            msg = side.hop(msg, edge_frame(g, hops[first], "_e").drop("_e"))
        elif last == first + 1 and not _sum_inside(side, nodes[first + 1]):
            a, b = hops[first], hops[last]
            mid = nodes[last]
            one = side.hop(msg, edge_frame(g, a, "_e").drop("_e"))
            both = side.hop(side.node(one, mid), edge_frame(g, b, "_e").drop("_e"))
            again = _twice(g, a, b)
            if not _plain(mid):
                again = again.join(node_frame(g, N("_m", mid.label, mid.where)).drop("_m"), F.col("_mid") == F.col("_nk")).drop("_nk")
            minus = side.hop(msg, again.drop("_mid"), "w")
            minus = minus.select("_at", *[(-F.col(c)).alias(c) for c in ("n", *side.sums)])
            msg = both.unionByName(minus).groupBy("_at").agg(*[F.sum(c).alias(c) for c in ("n", *side.sums)]).filter("n > 0")
        else:
            msg = _joined(g, side, msg, nodes, hops, first, last)
        if last < len(hops) - 1:
            msg = side.node(msg, nodes[last + 1])
    return msg, before


def _sum_inside(side: _Side, n: N) -> bool:
    return any(alias == n.alias for alias, _ in side.values.values())


def _joined(g: PropertyGraph, side: _Side, msg, nodes: list[N], hops: list[E], first: int, last: int) -> DataFrame:
    """A run of overlapping hops as joined paths, met by the message at its start."""
    pattern: list = []
    for i in range(first, last + 2):
        # The ends' own conditions belong to the messages.
        n = nodes[i] if first < i <= last else N(f"_n{i}")
        mine = {v: c for v, (alias, c) in side.values.items() if alias == n.alias}
        pattern += [N(f"n{i}", n.label, n.where, [c for c in mine.values()])] + ([E(f"e{i}", hops[i].type, hops[i].direction, hops[i].where)] if i <= last else [])
    m = match(g, pattern)
    cols = {v: F.col(f"n{i}.{_q(c)}") for i in range(first + 1, last + 1) for v, (alias, c) in side.values.items() if alias == nodes[i].alias}
    steps = m.select(F.col(f"n{first}.NODE").alias("_at"), F.col(f"n{last + 1}.NODE").alias("_far"), *[c.alias(f"_v_{v}") for v, c in cols.items()])
    over = steps.withColumns({"n": F.lit(1).cast("long"), **{c: F.lit(0) for c in side.sums}}) if msg is None else splittable_join(steps, msg, ["_at"], "inner")
    for v in cols:
        over = over.withColumns({f"s_{v}": F.coalesce(F.col(f"_v_{v}"), F.lit(0)) * F.col("n"), f"c_{v}": F.when(F.col(f"_v_{v}").isNotNull(), F.col("n")).otherwise(F.lit(0).cast("long"))})
    return side._carried(over)


def count_paths(g: PropertyGraph, pattern: list, at: int | str = 0, values: dict[str, tuple[str, str]] | None = None,
                props: list | None = None) -> DataFrame:
    """Matches of ``pattern`` counted at one of its nodes.

    One row per node ``at`` (alias or position) with a match: NODE, the
    node's ``props``, ``n`` (its matches), and for every ``name: (alias,
    property)`` of ``values`` the sum of that node property over the matches
    (null if none has it). Equal to grouping :func:`match` by that node.
    Counts are longs; a count beyond them is an error in ANSI mode."""
    nodes, hops = pattern[0::2], pattern[1::2]
    if isinstance(at, str):
        at = [n.alias for n in nodes].index(at)
    values = values or {}
    here, out = nodes[at], None
    runs = [r for r in _runs(hops) if r[0] < at <= r[1]]
    if runs and runs[0] != (at - 1, at) or runs and _sum_inside(_Side(g, values), here):
        # An overlapping run lies across the node in a longer way: its paths are joined.
        m = match(g, [N(n.alias, n.label, n.where, [c for a, c in values.values() if a == n.alias]) if isinstance(n, N) else n for n in pattern])
        out = m.groupBy(F.col(f"{here.alias}.NODE").alias("NODE")).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"{a}.{_q(c)}")).alias(v) for v, (a, c) in values.items()])
        return _with_props(g, out, props)
    before = {n.alias for n in nodes[:at]}
    left, right = (_Side(g, {v: x for v, x in values.items() if (x[0] in before) == is_left}) for is_left in (True, False))
    right.values = {v: x for v, x in right.values.items() if x[0] != here.alias}
    right.sums = [c for v in right.values for c in (f"s_{v}", f"c_{v}")]
    flipped = [E(e.alias, e.type, _FLIP[e.direction], e.where) for e in reversed(hops[at:])]
    lm, lb = _toward(g, left, nodes[:at + 1], hops[:at]) if at else (None, None)
    rm, rb = _toward(g, right, nodes[:at - 1 if at else None:-1], flipped) if at < len(hops) else (None, None)
    own = {v: c for v, (a, c) in values.items() if a == here.alias}
    base = g.nodes
    if here.label is not None:
        base = base.filter(F.array_contains("labels", here.label))
    if here.where is not None:
        base = base.filter(here.where)
    extra = [p for p in (props or []) if p != "NODE"]
    j = base.select("NODE", *[F.col(_q(p)) for p in extra], *[F.col(_q(c)).alias(f"_o_{v}") for v, c in own.items()])

    def joined(j: DataFrame, msg: DataFrame | None, tag: str, side: _Side) -> DataFrame:
        if msg is None:
            return j.withColumns({f"{tag}n": F.lit(1).cast("long")})
        return j.join(msg.select(F.col("_at").alias("NODE"), *[F.col(c).alias(f"{tag}{c}") for c in ("n", *side.sums)]), "NODE")

    j = joined(joined(j, lm, "l_", left), rm, "r_", right)
    n = F.col("l_n") * F.col("r_n")
    sums = {v: (F.col(f"l_s_{v}") * F.col("r_n"), F.col(f"l_c_{v}") * F.col("r_n")) for v in left.values}
    sums |= {v: (F.col(f"r_s_{v}") * F.col("l_n"), F.col(f"r_c_{v}") * F.col("l_n")) for v in right.values}
    if runs:
        # The hops on both sides can be the same edge: such pairs are counted through the edges at this node.
        j = _straddled(g, j, left, right, lb, rb, hops[at - 1], hops[at])
        n = n - F.coalesce("x_n", F.lit(0))
        sums = {v: tuple(t - F.coalesce(F.col(f"x_{k}_{v}"), F.lit(0)) for k, t in zip("sc", s)) for v, s in sums.items()}
    sums |= {v: (F.coalesce(F.col(f"_o_{v}"), F.lit(0)) * n, F.when(F.col(f"_o_{v}").isNotNull(), n).otherwise(F.lit(0))) for v in own}
    return j.select("NODE", *[F.col(_q(p)) for p in extra], n.cast("long").alias("n"),
                    *[F.when(sums[v][1] > 0, sums[v][0]).alias(v) for v in values]).filter("n > 0")


def _straddled(g: PropertyGraph, j: DataFrame, left: _Side, right: _Side, lb, rb, a: E, b: E) -> DataFrame:
    """``j`` with x_ columns: matches whose hops before and behind the node are one edge."""
    again = _twice(g, a, b)
    for tag, msg, side, end in (("l_", lb, left, "_near"), ("r_", rb, right, "_far")):
        if msg is None:
            again = again.withColumn(f"{tag}n", F.lit(1).cast("long"))
        else:
            again = splittable_join(again, msg.select(F.col("_at").alias(end), *[F.col(c).alias(f"{tag}{c}") for c in ("n", *side.sums)]), [end], "inner")
    terms = {"x_n": F.col("l_n") * F.col("r_n")}
    terms |= {f"x_{k}_{v}": F.col(f"l_{k}_{v}") * F.col("r_n") for v in left.values for k in "sc"}
    terms |= {f"x_{k}_{v}": F.col(f"r_{k}_{v}") * F.col("l_n") for v in right.values for k in "sc"}
    minus = again.groupBy(F.col("_mid").alias("NODE")).agg(*[F.sum(t * F.col("w")).alias(c) for c, t in terms.items()])
    return j.join(minus, "NODE", "left")


def _with_props(g: PropertyGraph, counted: DataFrame, props: list | None) -> DataFrame:
    extra = [p for p in (props or []) if p != "NODE"]
    if not extra:
        return counted
    rest = [c for c in counted.columns if c != "NODE"]
    return counted.join(g.nodes.select("NODE", *[F.col(_q(p)) for p in extra]), "NODE").select("NODE", *[F.col(_q(p)) for p in extra], *rest)
