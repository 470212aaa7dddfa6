"""Operator 12: Merkle manifest of a dataset with multiproofs per leaf partition.

Every row is a leaf; the leaves of a group (``source``), in id order, are
hashed up 16 at a time to the group's subroot, and the subroots, in group
order, likewise to the root. ``build`` numbers the leaves, and writes the
levels; ``prove`` cuts the leaves into partitions of ``PART`` consecutive
ones. Each partition works out the smallest set of nodes that the proofs of
all its leaves need and that its own leaves cannot give (a range left and
right of it on every level), fetches these once, derives all shared interior
nodes and spells out and checks every single proof.

Defined results: a null field is hashed as ``-``; a null or empty group is a
group of its own (null first); null ids come first in their group and are
never tampered with; rows equal in every hashed field are leaves of their
own, side by side; an empty table has no rows and no root. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import splittable_join
from .shared import numbered, written

BITS = 4                # 16 children a node
PART = 4096             # leaves of a partition; a power of 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = 60 // BITS       # levels of the largest tree that fits in a long


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Hash of a row: every field as ``-`` or its UTF-8 length, ``:``, value."""
    said = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in said]), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Manifest:
    """``rows``: g (place of the leaf in the whole), id, leaf, tampered (or
    null), tree, idx, n; ``nodes``: layer (0 a group's tree, 1 the tree of the
    subroots), tree, level, idx, h; ``trees``: group, tree, n, subroot."""
    rows: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int
    root: str | None


def _levels(base: DataFrame, most: int, name: str) -> list[DataFrame]:
    """All levels (tree, idx, h, n) above ``base``, n its leaves in the tree;
    a tree is as high as 16 ** height covers n."""
    out, level = [base], 0
    while most > 1 << (BITS * level):
        up = (out[-1].filter(F.col("n") > F.lit(1 << (BITS * level)))
              .groupBy("tree", F.shiftright("idx", BITS).alias("idx"), "n")
              .agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("run"))
              .select("tree", "idx", F.sha2(F.array_join(F.col("run.h"), ""), 256).alias("h"), "n"))
        out.append(written(up, name))
        level += 1
    return out


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, h) of every tree's last level."""
    tops = [x.filter(F.col("n") <= F.lit(1 << (BITS * k))) for k, x in enumerate(levels)]
    return reduce(DataFrame.unionByName, tops).select("tree", "h")


def build(docs: DataFrame, fields: tuple = FIELDS, id_col: str = "doc_id", group_col: str = "source", tamper: Column | None = None) -> Manifest:
    """Leaves, their numbers and all levels. ``tamper``: rows whose hash is
    also taken with the text's capitals lowered (default: none)."""
    cols = [F.col(f"`{f}`") for f in fields]
    forged = [lowered(c.cast("string")) if f == "text" else c for f, c in zip(fields, cols)]
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(F.col(f"`{id_col}`").alias("id"), F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("grp"),
                         leaf(cols).alias("leaf"), (F.when(tamper, leaf(forged)) if tamper is not None else F.lit(None).cast("string")).alias("tampered"),
                         # Spreads rows that are equal throughout; their order changes nothing.
                         F.monotonically_increasing_id().bitwiseAND(1023).alias("spread"))
    rows = numbered(written(leaves, "leaves"), [F.col("grp"), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("spread")], "g").drop("spread")
    groups = written(rows.groupBy("grp").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n")), "groups")
    groups = numbered(groups, [F.col("start")], "tree")
    size = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    rows = written(splittable_join(rows, groups, ["grp"], "inner")
                   .select("g", "id", "leaf", "tampered", "tree", (F.col("g") - F.col("start")).alias("idx"), "n"), "rows")
    low = _levels(rows.select("tree", "idx", F.col("leaf").alias("h"), "n"), size[0] or 0, "level")
    trees = written(groups.select(F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("group"), "tree", "n")
                    .join(_tops(low).withColumnRenamed("h", "subroot"), "tree"), "trees")
    high = _levels(trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("h"),
                                F.lit(size[1]).cast("long").alias("n")), size[1], "root")
    top = _tops(high).first()
    # A leaf is fetched only by the partition beside it.
    edge = rows.filter((F.col("g") % PART < 15) | (F.col("g") % PART >= PART - 15)).select("tree", "idx", F.col("leaf").alias("h"), "n")
    nodes = [x.withColumns({"layer": F.lit(layer), "level": F.lit(k)}) for layer, levels in ((0, [edge, *low[1:]]), (1, high)) for k, x in enumerate(levels)]
    return Manifest(rows, reduce(DataFrame.unionByName, nodes).drop("n"), trees, size[1], top and top["h"])


def missing(segments: DataFrame) -> DataFrame:
    """The smallest set of nodes beside each segment (part, layer, tree, lo,
    hi, n): (part, layer, tree, level, idx). On every level below the top the
    segment has the nodes ``lo >> 4 level`` to ``hi >> 4 level``; what it
    lacks are the rest of its first and of its last run."""
    at = segments.withColumn("level", F.explode(F.expr(f"filter(sequence(0, {_TOP}), l -> n > shiftleft(1L, l * {BITS}))")))
    at = at.select("part", "layer", "tree", "level", *[F.expr(f"shiftright({c}, level * {BITS})").alias(c) for c in ("lo", "hi")],
                   F.expr(f"shiftright(n + shiftleft(1L, level * {BITS}) - 1, level * {BITS})").alias("n"))
    first, last = F.expr("lo - lo % 16"), F.expr("least(hi - hi % 16 + 16, n)")
    none = F.array().cast("array<bigint>")
    sides = F.concat(F.when(first < F.col("lo"), F.sequence(first, F.col("lo") - 1)).otherwise(none),
                     F.when(last > F.col("hi") + 1, F.sequence(F.col("hi") + 1, last - 1)).otherwise(none))
    return at.select("part", "layer", "tree", "level", F.explode(sides).alias("idx"))


class Climb:
    """The known part of one tree: every level's runs, complete, and its top.

    ``have``: hashes of the consecutive nodes from ``lo``; ``more``: fetched
    nodes by (level, idx); ``n``: leaves of the tree."""

    def __init__(self, have: list[str], lo: int, n: int, more: dict):
        self.levels: list[tuple[int, list[str]]] = []    # (first run, the runs' hashes joined)
        level = 0
        while n > 1:
            hi = lo + len(have) - 1
            first, last = lo & ~15, min((hi | 15) + 1, n)
            have = [*(more[level, i] for i in range(first, lo)), *have, *(more[level, i] for i in range(hi + 1, last))]
            runs = ["".join(have[i:i + 16]) for i in range(0, len(have), 16)]
            self.levels.append((first >> BITS, runs))
            have, lo, n, level = [digest(r) for r in runs], first >> BITS, (n + 15) >> BITS, level + 1
        self.top = have[0]

    def siblings(self, i: int, start: int = 0) -> str:
        """The others of the run of node ``i``, level by level from ``start``."""
        out = []
        for first, runs in self.levels[start:]:
            run, at = runs[(i >> BITS) - first], (i & 15) * 64
            out.append(run[:at] + run[at + 64:])
            i >>= BITS
        return "".join(out)

    def fold(self, h: str, i: int) -> str:
        """The top that follows if node ``i`` of the lowest level were ``h``."""
        for first, runs in self.levels:
            run, at = runs[(i >> BITS) - first], (i & 15) * 64
            h, i = digest(run[:at] + h + run[at + 64:]), i >> BITS
        return h


def expand(rows: pd.DataFrame, fetched: pd.DataFrame, n_trees: int, spell: bool = False) -> pd.DataFrame:
    """Proofs of one partition's leaves from its fetched nodes."""
    rows = rows.sort_values("g", kind="stable")
    more: dict = {}
    for layer, tree, level, idx, h in zip(fetched.layer, fetched.tree, fetched.level, fetched.idx, fetched.h):
        more.setdefault(None if layer else tree, {})[level, idx] = h
    trees = rows.tree.to_numpy()
    cut = [0, *(np.flatnonzero(trees[1:] != trees[:-1]) + 1).tolist(), len(rows)]
    leaves, forged = rows.leaf.tolist(), rows.tampered.tolist()
    idx, ns = rows.idx.tolist(), rows.n.tolist()
    climbs = [Climb(leaves[a:b], idx[a], ns[a], more.get(trees[a], {})) for a, b in zip(cut, cut[1:])]
    whole = Climb([c.top for c in climbs], int(trees[0]), n_trees, more.get(None, {}))
    out: dict[str, list] = {"subroot": [], "proof": [], "proof_sha256": [], "folded_root": []}
    for c, a, b in zip(climbs, cut, cut[1:]):
        tree = int(trees[a])
        beyond = whole.siblings(tree)
        above: dict[int, str] = {}
        for j in range(a, b):
            i = idx[j]
            if i >> BITS not in above:
                above[i >> BITS] = c.siblings(i >> BITS, 1) + beyond
            first, runs = c.levels[0] if c.levels else (0, None)
            own = "" if runs is None else runs[(i >> BITS) - first]
            at = (i & 15) * 64
            proof = own[:at] + own[at + 64:] + above[i >> BITS]
            out["proof"].append(proof if spell else None)
            out["proof_sha256"].append(digest(proof))
            # An untouched leaf folds to the interiors that the partition shares.
            out["folded_root"].append(whole.top if forged[j] is None else whole.fold(c.fold(forged[j], i), tree))
        out["subroot"] += [c.top] * (b - a)
    return pd.DataFrame({"id": rows.id, "leaf": leaves} | out | {"g": rows.g})


def prove(manifest: Manifest, id_col: str = "doc_id", spell: bool = False) -> DataFrame:
    """One row per leaf: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``,
    ``folded_root``, ``verified``, and with ``spell`` the ``proof`` itself
    (siblings as hex digests, 64 characters each)."""
    part = F.shiftright("g", PART.bit_length() - 1).alias("part")
    rows = manifest.rows.withColumn("part", part)
    low = rows.groupBy("part", "tree").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.max("n").alias("n"))
    low = low.select("part", F.lit(0).alias("layer"), "tree", "lo", "hi", "n")
    high = low.groupBy("part").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi"))
    high = high.select("part", F.lit(1).alias("layer"), F.lit(0).cast("long").alias("tree"), "lo", "hi", F.lit(manifest.n_trees).cast("long").alias("n"))
    wanted = missing(low.unionByName(high))
    fetched = written(wanted.join(manifest.nodes, ["layer", "tree", "level", "idx"]), "fetched")
    kind, n_trees = dict(rows.dtypes)["id"], manifest.n_trees
    rows = rows.withColumn("id", F.col("id").cast("string"))    # pandas would turn integers beside a null into doubles

    def run(_key, mine: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return expand(mine, got, n_trees, spell)

    out = rows.groupBy("part").cogroup(fetched.groupBy("part")).applyInPandas(
        run, "id string, leaf string, subroot string, proof string, proof_sha256 string, folded_root string, g bigint")
    out = out.withColumn("root", F.lit(manifest.root))
    said = [F.col("id").cast(kind).alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")]
    return out.select(*said, *(["proof"] if spell else []))


def tampered_ids(id_col: str = "doc_id") -> Column:
    """True where 5 divides the unsigned crc32 of the id's decimal text."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def manifest_rows(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` with every proof checked, a fifth of them
    against a leaf with lowered capitals."""
    return prove(build(docs, tamper=tampered_ids()))
