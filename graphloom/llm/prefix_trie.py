"""Operator 13: the prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns (role, text). A turn is known by
its sha256, a sequence by the running sha256 of its turns. Conversations that
are equal throughout are one sequence with several members. Peeling goes from
the deepest depth that two sequences share up to the root: the sequences that
end at a depth, or join others there, merge with the nodes that survive from
below; grouping by the sequence gives the depth's nodes with all their
figures, and stripping the last turn makes them the children of the next
depth. What a sequence has to itself below its last shared node (its tail) is
one path that nothing else can join, so all tails are peeled at once and the
number of rounds is the depth that is shared, not the longest conversation.

Defined results: rows with a null conversation id are no conversation; a null
role or text is empty; null turns come first; rows with the same turn follow
role, then the text's first 32 characters, then the hash of both (repeated
rows stay, as turns of their own). An empty table has no nodes, not even a
root. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import splittable_join
from .shared import numbered, scratch, written

EMPTY = hashlib.sha256(b"").hexdigest()
PIECE = 64 << 10        # characters of joined ids in a row



def _none() -> Column:
    return F.lit(None).cast("binary")


def turn_rows(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, ids): every turn as c, pos (from 1), turn (its hash), bytes (of
    its text); and every conversation as c, n (its turns).

    Only hashes are sorted, not texts; a conversation with very many turns is
    spread over tasks by the range sort."""
    role, text = (F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) for x in (role_col, text_col))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = convs.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("c"), F.col(f"`{turn_col}`").alias("at"), role.alias("role"),
        F.substring(text, 1, 32).alias("head"), F.unhex(F.sha2(said, 256)).alias("turn"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().bitwiseAND(1023).alias("spread"))
    rows = numbered(written(rows, "turns"), [F.col("c"), F.col("at").asc_nulls_first(), F.col("role"), F.col("head"), F.col("turn"), F.col("spread")], "g")
    ids = written(rows.groupBy("c").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n")), "conversations")
    rows = splittable_join(rows.select("c", "g", "turn", "bytes"), ids, ["c"], "inner")
    return written(rows.select("c", (F.col("g") - F.col("start") + 1).alias("pos"), "turn", "bytes"), "turns"), ids.select("c", "n")


def rebuilt(rows: DataFrame, ids: DataFrame, siblings: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation c as the first h = crc32(c) mod ``heads`` turns of
    conversation c - c mod ``siblings`` and its own turns after its first h:
    (rows: c, d, turn, bytes, len; ids: c, len)."""
    kin = ids.select("c", "n", (F.col("c") - F.col("c") % siblings).alias("b"), (F.crc32(F.col("c").cast("string")) % heads).alias("h"))
    of = ids.select(F.col("c").alias("b"), F.col("n").alias("n_b"))
    taken = F.least("h", F.coalesce("n_b", F.lit(0)))
    kin = written(kin.join(of, "b", "left").select("c", "b", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "kin")
    own = splittable_join(rows, kin, ["c"], "inner").filter("pos > h").select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("d"), "turn", "bytes", "len")
    first = rows.filter(F.col("pos") < heads).select(F.col("c").alias("b"), F.col("pos").alias("d"), "turn", "bytes")
    lent = kin.join(first, "b").filter("d <= h").select("c", "d", "turn", "bytes", "len")
    return own.unionByName(lent), kin.select("c", "len")


def _chained(rows: DataFrame) -> DataFrame:
    """``rows`` with key (the sequence up to this turn), parent (the one
    before) and cum (bytes so far). A conversation's turns pass one task as a
    stream of hashes; a batch is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, key, cum = None, b"", 0
        for batch in batches:
            keys, parents, cums = [], [], []
            for conv, turn, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if conv != c:
                    c, key, cum = conv, b"", 0
                parents.append(key)
                key = hashlib.sha256(key + turn).digest()[:16]
                cum += size
                keys.append(key)
                cums.append(cum)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1, 3, 4)] + [pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), pa.array(cums, pa.int64())],
                                             names=["c", "d", "bytes", "len", "key", "parent", "cum"])

    src = rows.select("c", "d", "turn", "bytes", "len").repartition("c").sortWithinPartitions("c", "d")
    return src.mapInArrow(run, "c long, d long, bytes long, len long, key binary, parent binary, cum long")


def _members(ended: DataFrame) -> DataFrame:
    """One row per sequence from its members (key, c, len, total): key, rep
    (smallest member), m, ends (hash of the joined ids), len, total.

    Ids are sorted over all tasks and joined to pieces of text there; only the
    pieces of a sequence meet, to be hashed in order as a stream."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            room = 0
            for key, c, n, total in zip(*(x.to_pylist() for x in batch.columns)):
                if not out or out[-1][0] != key or room <= 0:
                    out.append([key, c, n, total, []])
                    room = PIECE
                out[-1][4].append(str(c))
                room -= len(out[-1][4][-1]) + 1
            yield pa.RecordBatch.from_pydict({"key": pa.array([x[0] for x in out], pa.binary()), **{
                k: pa.array([x[i] for x in out], pa.int64()) for i, k in ((1, "c"), (2, "len"), (3, "total"))},
                "m": pa.array([len(x[4]) for x in out], pa.int64()), "said": [",".join(x[4]) for x in out]})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array([x[0] for x in rows], pa.binary()), **{
                k: pa.array([x[i] for x in rows], pa.int64()) for i, k in ((1, "rep"), (2, "len"), (3, "total"), (4, "m"))}, "ends": [x[5] for x in rows]})
        for batch in batches:
            done = []
            for key, c, n, total, m, said in zip(*(x.to_pylist() for x in batch.columns)):
                if now is not None and now[0] == key:
                    now[4] += m
                    sha.update(b"," + said.encode())
                else:
                    if now is not None:
                        done.append([*now, sha.hexdigest()])
                    now, sha = [key, c, n, total, m], hashlib.sha256(said.encode())
            if done:
                yield out(done)
        if now is not None:
            yield out([[*now, sha.hexdigest()]])

    some = ended.repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(pieces, "key binary, c long, len long, total long, m long, said string")
    return some.repartition("key").sortWithinPartitions("key", "c").mapInArrow(joined, "key binary, rep long, len long, total long, m long, ends string")


def trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """All nodes from rows (c, d, turn, bytes, len) and ids (c, len):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    rows = written(_chained(rows), "chained")
    ended = rows.filter("d = len").select("key", "c", "len", F.col("cum").alias("total"))
    bare = ids.filter("len = 0").select(F.lit(b"").alias("key"), "c", "len", F.lit(0).cast("long").alias("total"))
    seqs = written(_members(ended.unionByName(bare)), "sequences")

    # One member of each sequence stands for all; its rows are marked where two sequences share them.
    lead = splittable_join(rows, seqs.select(F.col("rep").alias("c"), "m", "ends", "total"), ["c"], "inner")
    shared = written(rows.join(seqs.select(F.col("rep").alias("c")), "c", "left_semi").groupBy("key")
                     .agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
                     .filter("n > 1").drop("n"), "shared")
    tail = written(splittable_join(lead, shared.select("key"), ["key"], "left_anti")
                   .withColumn("saved", (F.col("m") - 1) * (F.col("total") - F.col("cum") + F.col("bytes"))), "tails")

    # What arrives at a depth: its shared sequences, those that end there, and the tops of tails below it.
    zero = F.lit(0).cast("long")
    tops = tail.groupBy("c").agg(F.min(F.struct("d", "parent", "m", "saved")).alias("t")).select("c", "t.*")
    arriving = (shared.select(F.col("d").alias("depth"), "key", "parent", "bytes", F.lit(None).cast("long").alias("conv"), zero.alias("n_convs"),
                              zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"), F.lit(None).cast("string").alias("ends"))
                .unionByName(tops.select((F.col("d") - 1).alias("depth"), F.col("parent").alias("key"), _none().alias("parent"), zero.alias("bytes"), F.col("c").alias("conv"),
                                         F.col("m").alias("n_convs"), (zero + 1).alias("n_children"), (zero + 1).alias("n_leaves"), "saved", F.lit(None).cast("string").alias("ends")))
                .unionByName(seqs.join(shared.select("key").unionByName(spark.range(1).select(F.lit(b"").alias("key"))), "key", "left_semi")
                             .select(F.col("len").alias("depth"), "key", _none().alias("parent"), zero.alias("bytes"), F.col("rep").alias("conv"), F.col("m").alias("n_convs"),
                                     zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"), "ends")))
    path = scratch(spark, "arriving")
    arriving.write.partitionBy("depth").parquet(path)
    arriving = spark.read.schema(arriving.schema).parquet(path)
    deepest = shared.agg(F.max("d")).first()[0] or 0

    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        here = arriving.filter(F.col("depth") == depth).drop("depth")
        if levels:  # strip the last turn
            here = here.unionByName(levels[-1].select(F.col("parent").alias("key"), _none().alias("parent"), zero.alias("bytes"), "conv", "n_convs",
                                                      (zero + 1).alias("n_children"), "n_leaves", "saved", F.lit(None).cast("string").alias("ends")))
        node = here.groupBy("key").agg(F.max("parent").alias("parent"), F.max("bytes").alias("bytes"), F.min("conv").alias("conv"), *[
            F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends").alias("ends"))
        levels.append(written(node.select(
            F.lit(depth).cast("long").alias("depth"), "key", "parent", "conv", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.coalesce("ends", F.lit(EMPTY)).alias("ends")), "peeled"))

    nodes = reduce(DataFrame.unionByName, levels)
    alone = tail.select(F.col("d").alias("depth"), "key", "parent", F.col("c").alias("conv"), F.col("m").alias("n_convs"), F.when(F.col("d") < F.col("len"), zero + 1).otherwise(zero).alias("n_children"),
                        (zero + 1).alias("n_leaves"), "saved", F.when(F.col("d") == F.col("len"), F.col("ends")).otherwise(EMPTY).alias("ends"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("above"))
    said = splittable_join(nodes.unionByName(alone), above, ["parent"], "left")
    return said.select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv")).alias("parent_conv_id"),
                       "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def conversation_trie(convs: DataFrame, **cols) -> DataFrame:
    """The trie of the conversations as they are."""
    rows, ids = turn_rows(convs, **cols)
    ids = ids.withColumnRenamed("n", "len")
    return trie(splittable_join(rows.withColumnRenamed("pos", "d"), ids, ["c"], "inner"), ids)


def rebuilt_trie(convs: DataFrame, siblings: int = 5, heads: int = 9, **cols) -> DataFrame:
    """The trie of the rebuilt conversations (see :func:`rebuilt`)."""
    return trie(*rebuilt(*turn_rows(convs, **cols), siblings, heads))
