"""Operator 1: n-gram Jaccard self-join by universe partitioning.

Documents are sets of distinct word 4-shingles. Two sets link when
``100 * |intersection| >= min_percent * |union|``.

* **Size bands.** Sizes are cut into bands; a set can only link to sets of
  its own band or of the band below.
* **Universe partition, pigeonhole.** In a band every shingle is hashed to
  one of ``m`` segments. Linked sets differ in at most ``H`` shingles, so if a
  set looks up segments worth more than ``H`` (worth 1: the same subset;
  worth 2: the same subset or one shingle apart), one look-up must hit.
* **Index.** Every set writes the hash of each segment subset, and for the
  first ``c`` segments of the band also the hashes with one shingle left out
  (the one-deletion neighbourhood).
* **Cost-based allocation.** ``allocate`` chooses ``m`` and ``c`` per band
  from the band's row count, so that a set can afford to skip empty segments
  (worth 0); the look-ups left over are given up for the most crowded subsets
  (``_drop_crowded``). Only what the pigeonhole bound does not need is skipped:
  no link is lost.
* **Verification.** Candidates whose sizes and parity sketches (as wide as the
  sets are large) allow a link are checked on the whole sets. Members of a subset are first checked against
  one leader, the set that shares most; after a few rounds of leaders only
  members beside a subset's main component are still paired, with members of
  other components. Copies are one set throughout, so they are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import fs
from . import textnp as T
from .shared import bounded_batches, components, grown, scratch, tidy, written
from .shingles import shingle_sets

# Tag bits kept in the low byte of a signature key.
PROBE, INDEX, DELETED, PAIRED = 1, 2, 4, 8
SLACK_SHIFT, SLACK_MAX, TAG_BITS = 4, 15, 8

_U = np.uint64


class Bands:
    """Size bands and the pigeonhole bound for a threshold in percent."""

    def __init__(self, percent: int, largest: int, ratio: float = 1.3):
        self.percent = percent
        edges = [1]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, int(edges[-1] * ratio), -(-100 * edges[-1] // percent)))
        self.edges = np.array(edges, dtype=np.int64)

    def of(self, size):
        return np.searchsorted(self.edges, size, side="right") - 1

    def top(self, band: int) -> int:
        return int(self.edges[band + 1]) - 1

    def smallest_partner(self, size: int) -> int:
        return -(-self.percent * size // 100)

    def differ(self, total: int) -> int:
        """Most shingles in which linked sets of together ``total`` can differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def most(self, band: int) -> int:
        """The bound of the band's hardest look-up (from the band above, or its own top)."""
        top = self.top(band)
        return self.differ(top + max(top, 100 * top // self.percent))

    def need(self, size: int, band: int) -> int:
        """Worth of the look-ups that a set of ``size`` needs in ``band`` against smaller or equal sets."""
        return self.differ(size + min(size, self.top(band))) + 1


def allocate(bands: Bands, counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Segments and one-deletion segments of each band that has sets.

    Minimises the rows written per set plus the expected look-ups of empty
    segments, over extra segments (one row each) and one-deletion segments
    (a row per shingle in them)."""
    plan = {}
    for band in sorted({b for k in counts for b in (k, k - 1) if b >= 0}):
        most, size = bands.most(band), (bands.edges[band] + bands.top(band)) / 2
        if most == 0:
            continue  # only equal sets can link
        n = counts.get(band, 0) + counts.get(band + 1, 0)
        best = None
        extras = sorted({*range(5), *(int(1.4 ** j) for j in range(5, 60) if 1.4 ** j <= most / 6)})
        for c in (0, 1, 2, 3, 4, 6, 8):
            for m in (max(1, c, most + 1 - c + x) for x in extras if c <= most + 1):
                spare, t = m + c - most - 1, size / m
                p = math.exp(-t)
                # Expected empty segments beyond the spare worth (binomial, by its recurrence).
                q, over = (1 - p) ** m, 0.0
                for s in range(m + 1):
                    over += q * max(0, s - spare)
                    if s > m * p + 40 and q < 1e-12:
                        break
                    q *= (m - s) / (s + 1) * p / (1 - p)
                cost = m + c * t + over * n * p
                if best is None or cost < best[0]:
                    best = (cost, m, c)
        plan[band] = best[1:]
    return plan


def signatures(sets: list[np.ndarray], names: np.ndarray, bands: Bands, plan: dict[int, tuple[int, int]]):
    """Keys and set names of all index and look-up rows of some sets."""
    keys, owners = [], []

    def emit(key, tag, owner):
        keys.append((key << _U(TAG_BITS)) | tag.astype(_U))
        owners.append(owner)

    jobs: dict[tuple[int, int], list[int]] = {}
    for d, s in enumerate(sets):
        if not len(s):
            continue
        own = int(bands.of(len(s)))
        jobs.setdefault((own, 1), []).append(d)
        for low in range(int(bands.of(bands.smallest_partner(len(s)))), own):
            jobs.setdefault((low, 0), []).append(d)
    for (band, own), docs in jobs.items():
        if band not in plan:
            continue
        m, c = plan[band]
        sizes = np.array([len(sets[d]) for d in docs])
        token = np.concatenate([sets[d] for d in docs])
        row = np.repeat(np.arange(len(docs)), sizes)
        salted = T.mix(token ^ _U(band + 1))
        seg = ((salted >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        cell = row * m + seg
        value = T.mix(salted)
        cells = len(docs) * m
        # Exact sums of the 64-bit values modulo 2**64, by halves.
        low = np.bincount(cell, weights=(value & _U(0xFFFFFFFF)).astype(np.float64), minlength=cells)
        high = np.bincount(cell, weights=(value >> _U(32)).astype(np.float64), minlength=cells)
        total = low.astype(_U) + (high.astype(_U) << _U(32))
        count = np.bincount(cell, minlength=cells)
        where = T.mix(np.arange(m, dtype=_U) * _U(2) + _U(band << 40))
        key = T.mix(total + np.tile(where, len(docs))) >> _U(TAG_BITS)
        # Worth of each segment's look-ups: an empty subset is skipped, one shingle alone is
        # looked up without its (empty) neighbour, unless the set is short of worth.
        count = count.reshape(len(docs), m)
        full = np.ones((1, m), dtype=np.int64)
        full[:, :c] = 2
        worth = np.minimum(count, full)
        spare = worth.sum(axis=1) - np.array([bands.need(int(n), band) for n in sizes])
        extra = full - worth
        also = (extra > 0) & (np.cumsum(extra, axis=1) - extra < np.maximum(0, -spare)[:, None])
        probe = (count > 0) | also
        slack = np.clip(spare, 0, SLACK_MAX)
        tag = probe * PROBE + own * INDEX
        tag[:, :c] |= PAIRED
        tag |= slack[:, None] << SLACK_SHIFT
        mine = np.repeat(names[docs], m)
        keep = (tag & (PROBE | INDEX) > 0).ravel()
        emit(key[keep], tag.ravel()[keep], mine[keep])
        if c:
            t = seg < c
            cut = cell[t]
            dkey = T.mix(total[cut] - value[t] + where[seg[t]]) >> _U(TAG_BITS)
            two = (count.ravel()[cut] >= 2) | also.ravel()[cut]
            dtag = two * PROBE + own * INDEX + DELETED + PAIRED + (slack[row[t]] << SLACK_SHIFT)
            dkeep = dtag & (PROBE | INDEX) > 0
            emit(dkey[dkeep], dtag[dkeep], names[docs][row[t]][dkeep])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners).view(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set: its name and a second check."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return (int(T.mix(s).sum(dtype=_U).astype(np.int64)),
                int(T.mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).astype(np.int64)))


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                n, fa, fb = [], [], []
                for s in shingle_sets(part.column(part.schema.get_field_index("text")), k):
                    a, b = fingerprint(s)
                    n.append(len(s))
                    fa.append(a)
                    fb.append(b)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("tid")),
                     pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64())],
                    names=["doc_id", "tid", "n_shingles", "fa", "fb"])
    return run


def _signature_rows(k: int, bands: Bands, plan: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets this task has written: copies are written once
        for batch in batches:
            for part in T.slices(batch, "text"):
                sets, names = [], []
                for s in shingle_sets(part.column(0), k):
                    if len(s):
                        a, _ = fingerprint(s)
                        if a not in seen:
                            seen.add(a)
                            sets.append(s)
                            names.append(a)
                key, node = signatures(sets, np.array(names, dtype=np.int64).view(_U), bands, plan)
                for i in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i:i + (1 << 16)]), pa.array(node[i:i + (1 << 16)])],
                                                     names=["key", "node"])
    return run


STARS = 1  # rounds of leaders after the first
HOLD = 1 << 16  # rows gathered before a look; a longer run of one signature streams through


def _shared_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (signature and tag, node) keep the signatures that
    two or more sets share and at least one looks up, numbered by ``gid``."""
    serial = TaskContext.get().partitionId() << 40
    key = node = np.zeros(0, np.int64)
    opened = None  # signature of a run that is being passed on

    def shape(gid, key, node):
        return pa.RecordBatch.from_arrays(
            [pa.array(gid, pa.int64()), pa.array((key & 0xFF).astype(np.int16)), pa.array(node)], names=["gid", "tag", "node"])

    def shared(key, node):
        nonlocal serial
        once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[once], node[once]
        sig = key >> TAG_BITS
        begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[begin, len(sig)])
        some = lambda x: np.logical_or.reduceat(x, begin)
        good = (size > 1) & some(key & PROBE > 0) & some(key & INDEX > 0) & some(key & DELETED == 0)
        rows = np.repeat(good, size)
        gid = serial + np.repeat(np.cumsum(good), size)[rows]
        serial += int(good.sum())
        return shape(gid, key[rows], node[rows])

    def settle(batch):
        nonlocal key, node, opened, serial
        if batch is not None:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            node = np.concatenate([node, batch.column(1).to_numpy(zero_copy_only=False)])
        if opened is not None:
            stop = int(np.searchsorted(key >> TAG_BITS, opened, side="right"))
            yield shape(np.full(stop, serial), key[:stop], node[:stop])
            key, node = key[stop:], node[stop:]
            if not len(key):
                return
            opened = None
        last = int(np.searchsorted(key >> TAG_BITS, key[-1] >> TAG_BITS, side="left")) if batch is not None and len(key) else len(key)
        if last:
            yield shared(key[:last], node[:last])
            key, node = key[last:], node[last:]
        if batch is not None and len(key) > HOLD:
            opened, serial = key[-1] >> TAG_BITS, serial + 1
            yield shape(np.full(len(key), serial), key, node)
            key, node = key[:0], node[:0]

    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= HOLD // 2:
            for x in waiting[:-1]:
                key = np.concatenate([key, x.column(0).to_numpy(zero_copy_only=False)])
                node = np.concatenate([node, x.column(1).to_numpy(zero_copy_only=False)])
            yield from settle(waiting[-1])
            waiting, n = [], 0
    for x in waiting:
        key = np.concatenate([key, x.column(0).to_numpy(zero_copy_only=False)])
        node = np.concatenate([node, x.column(1).to_numpy(zero_copy_only=False)])
    if len(key):
        yield from settle(None)


SKETCH = 8  # longs of a parity sketch


def wide_sketch(s: np.ndarray) -> bytes:
    """Parity sketch of a set with a bit or two for each shingle (a power of
    two); empty where the sketch of 64 * ``SKETCH`` bits has as many."""
    if len(s) <= 64 * SKETCH:
        return b""
    width = 1 << (len(s) - 1).bit_length()
    return np.packbits(np.bincount((T.mix(s + _U(5)) & _U(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def sketches_apart(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ, the longer one folded to the
    other's length: at most the number of shingles in which the sets differ."""
    if not a or not b:
        return 0
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _near(percent: int):
    """Of likely pairs those whose wide sketches do not exclude a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, a, b = (batch.column(i).to_pylist() for i in (4, 5, 6, 7))
            keep = [sketches_apart(u, v) <= (100 - percent) * (i + j) // (100 + percent) for i, j, u, v in zip(n, m, a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)], names=["x", "xb", "y", "yb"]).filter(pa.array(keep, pa.bool_()))
    return run


def _sets_of(k: int):
    """Sets with a sketch: the parity of the shingles in each of 64 * ``SKETCH``
    bits. Sketches differ in at most as many bits as sets in shingles. Larger
    sets have a wide sketch too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                sets = list(shingle_sets(part.column(part.schema.get_field_index("text")), k))
                marks = [fingerprint(s) for s in sets]
                bits = [np.packbits(np.bincount((T.mix(s + _U(5)) & _U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in marks], pa.int64()), pa.array([x[1] for x in marks], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()), *(pa.array([b[i] for b in bits], pa.int64()) for i in range(SKETCH)),
                     pa.array([wide_sketch(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["fa", "fb", "n", *(f"s{i}" for i in range(SKETCH)), "wide", "items"])
    return run


def _plausible(percent: int, a: str, b: str):
    """Sizes and sketches (columns with prefixes ``a`` and ``b``) that a link does not exclude."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(1, SKETCH)),
                F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= F.floor((100 - percent) * (n + m) / (100 + percent)))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            a, b = [], []
            for i in range(batch.num_rows):
                x = np.frombuffer(cols[2][i].as_buffer(), dtype=_U)
                y = np.frombuffer(cols[5][i].as_buffer(), dtype=_U)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    a.append(f"{cols[0][i]}.{cols[1][i]}")
                    b.append(f"{cols[3][i]}.{cols[4][i]}")
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])
    return run


def _drop_crowded(members: DataFrame, crowd: int) -> DataFrame:
    """Give up look-ups of crowded subsets as far as a set's spare worth goes.

    A set's spare in a band (kept in its tags) pays for whole subsets, the
    most crowded first; segments with a one-deletion neighbourhood are kept."""
    size = members.groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    m = members.join(size, "gid")
    can = (F.col("size") > crowd) & (F.col("tag").bitwiseAND(F.lit(PAIRED)) == 0) & (F.col("tag").bitwiseAND(F.lit(PROBE)) > 0)
    order = (Window.partitionBy("node", F.col("tag").bitwiseAND(F.lit(INDEX)), can).orderBy(F.desc("size"), "gid"))
    m = m.withColumn("_can", can).withColumn("_paid", F.row_number().over(order))
    spare = F.shiftright(F.col("tag"), SLACK_SHIFT)
    drop = F.col("_can") & (F.col("_paid") <= spare)
    return m.select("gid", "node", "root", "main", F.when(drop, F.col("tag") - PROBE).otherwise(F.col("tag")).alias("tag"))


def jaccard_links(docs: DataFrame, percent: int = 85, k: int = 4, id_col: str = "doc_id", text_col: str = "text",
                  crowd: int = 64) -> tuple[DataFrame, DataFrame]:
    """(sets, links) of :func:`linked_sets`."""
    return linked_sets(docs, percent, k, id_col, text_col, crowd)[:2]


def linked_sets(docs: DataFrame, percent: int = 85, k: int = 4, id_col: str = "doc_id", text_col: str = "text",
                crowd: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, links, roots). ``sets``: one row per document with its id, n_shingles
    and the name of its shingle set (``set_id``, null for the empty set).
    ``links``: (a, b) pairs of different linked set names that connect
    every component of the link graph (not every pair inside one). ``roots``:
    every linked set (``node``) and the smallest set name of its component.

    Null or wordless texts have no set and no link; repeated rows and copies
    share one set; repeated or null ids keep their rows; other columns are
    not read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("tid", F.xxhash64("text"))
    id_type = dict(src.dtypes)["doc_id"]
    sets = written(src.mapInArrow(_set_rows(k), f"doc_id {id_type}, tid long, n_shingles long, fa long, fb long"), "sets")
    named = sets.withColumn("set_id", F.when(F.col("n_shingles") > 0, F.concat_ws(".", "fa", "fb")))
    classes = (sets.filter("n_shingles > 0").groupBy("fa", "fb", "n_shingles")
               .agg(F.min(F.struct("doc_id", "tid")).alias("pick")))
    largest = sets.agg(F.max("n_shingles")).first()[0] or 1
    bands = Bands(percent, int(largest))
    edges = [int(x) for x in bands.edges]
    band = F.lit(0)
    for i, e in enumerate(edges):
        band = F.when(F.col("n_shingles") >= e, F.lit(i)).otherwise(band) if i else band
    # A row per size band (a few dozen), whatever the input.
    counts = {r["band"]: r["count"] for r in classes.groupBy(band.alias("band")).count().collect()}
    plan = allocate(bands, counts)

    # No name keeps these rows: once they are written, their shuffle can be cleaned up.
    found = scratch(spark, "members")
    (src.select("text").mapInArrow(_signature_rows(k, bands, plan), "key long, node long")
                      .repartition(F.shiftright("key", TAG_BITS)).sortWithinPartitions("key", "node")
                      .mapInArrow(_shared_signatures, "gid long, tag short, node long").write.parquet(found))
    tidy(spark)
    members = spark.read.schema("gid long, tag short, node long").parquet(found)
    # Weight of a set: the sizes of the subsets that it shares, so the text that others derive from leads.
    size = members.groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    weight = members.join(size, "gid").groupBy("node").agg(F.sum("size").alias("weight"))
    m = written(members.join(weight, "node"), "weighted")
    del members, size, weight
    tidy(spark)
    fs.delete(spark, found)

    need = m.select(F.col("node").alias("fa")).distinct()
    picks = classes.join(need, "fa", "left_semi").select("fa", "fb", F.col("pick.doc_id").alias("doc_id"), F.col("pick.tid").alias("tid"))
    same = (F.col("s.tid") == F.col("p.tid")) & F.col("s.doc_id").eqNullSafe(F.col("p.doc_id"))
    kept = scratch(spark, "items")
    made = (src.alias("s").join(picks.alias("p"), same, "left_semi").select("text")
                    .mapInArrow(_sets_of(k), "fa long, fb long, n long, " + ", ".join(f"s{i} long" for i in range(SKETCH)) + ", wide binary, items binary")
                    .dropDuplicates(["fa", "fb"]))
    made.write.parquet(kept)
    items = spark.read.schema(made.schema).parquet(kept)
    del made
    tidy(spark)

    facts = ["n", *(f"s{i}" for i in range(SKETCH))]
    fact = lambda p: items.select(F.col("fa").alias(p), F.col("fb").alias(f"{p}b"), *[F.col(c).alias(f"{p}{c}") for c in facts])
    part = lambda of, p, *cols: of.select(F.col("fa").alias(p), F.col("fb").alias(f"{p}b"), *[F.col(c).alias(f"{p}{c}") for c in cols])

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (x, y), the whole sets compared.

        Wide sketches come first: sets of thousands of shingles fill the short
        ones. Whole sets move only if they are in a pair that is left."""
        likely = pairs.join(fact("x"), "x").join(fact("y"), "y").filter(_plausible(percent, "x", "y") & ((F.col("x") != F.col("y")) | (F.col("xb") < F.col("yb"))))
        seen = (likely.select("x", "xb", "y", "yb", "xn", "yn").join(part(items, "x", "wide"), ["x", "xb"]).join(part(items, "y", "wide"), ["y", "yb"])
                .select("x", "xb", "y", "yb", "xn", "yn", "xwide", "ywide"))
        near = written(seen.mapInArrow(_near(percent), "x long, xb long, y long, yb long"), "near")
        ends = near.select(F.col("x").alias("fa"), F.col("xb").alias("fb")).unionByName(near.select(F.col("y").alias("fa"), F.col("yb").alias("fb"))).distinct()
        due = items.join(ends, ["fa", "fb"], "left_semi")
        both = near.join(part(due, "x", "items"), ["x", "xb"]).join(part(due, "y", "items"), ["y", "yb"])
        out = written(both.select("x", "xb", "xitems", "y", "yb", "yitems").mapInArrow(_verify(percent), "a string, b string"), "links")
        del likely, seen, near, ends, due, both
        tidy(spark)
        return out

    def star(rows: DataFrame, leads: DataFrame) -> DataFrame:
        """Every member of a subset against the heaviest of ``leads``, once for all subsets."""
        lead = leads.groupBy("gid").agg(F.max(F.struct("weight", "node")).alias("lead"))
        return (rows.join(lead, "gid").filter("node <> lead.node")
                .select(F.least("node", "lead.node").alias("x"), F.greatest("node", "lead.node").alias("y")).distinct())

    same_name = items.groupBy("fa").count().filter("count > 1").select(F.col("fa").alias("x"), F.col("fa").alias("y"))
    links = checked(star(m, m).unionByName(same_name))
    roots = grown(None, links)

    def unsettled(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Subsets whose members are in different components, with each member's
        component and whether it is that of the heaviest member."""
        of = roots.select(F.split("node", "[.]")[0].cast("long").alias("node"), "root").dropDuplicates(["node"])
        r = rows.join(of, "node", "left").withColumn("root", F.coalesce("root", F.col("node").cast("string")))
        per = r.groupBy("gid").agg(F.max(F.struct("weight", "node", "root"))["root"].alias("main"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        r = r.join(per.filter("r0 <> r1").select("gid", "main"), "gid")
        out = written(r.select("gid", "tag", "node", "weight", "root", (F.col("root") == F.col("main")).alias("main")), "unsettled")
        del of, r, per
        tidy(spark)
        return out

    rest = unsettled(m, roots)
    for _ in range(STARS):  # leaders of what is not linked to the first ones
        more = checked(star(rest, rest.filter("not main")))
        links, roots = links.unionByName(more), grown(roots, more)
        rest = unsettled(rest.select("gid", "tag", "node", "weight"), roots)

    # What is left pair by pair: members beside the main component against all others.
    rest = _drop_crowded(rest, crowd).join(fact("node").drop("nodeb"), "node")
    has = lambda c, bit: F.col(c).bitwiseAND(F.lit(bit)) > 0
    side = lambda p, bit, only: rest.filter(has("tag", bit) & only).select(
        "gid", F.col("node").alias(p), F.col("tag").alias(f"{p}t"), F.col("root").alias(f"{p}r"), *[F.col(f"node{c}").alias(f"{p}{c}") for c in facts])
    fits = (F.col("pr") != F.col("ir")) & ~(has("pt", DELETED) & has("it", DELETED)) & _plausible(percent, "p", "i")
    beside, main = ~F.col("main"), F.col("main")
    pairs = [side("p", PROBE, a).join(side("i", INDEX, b), "gid").filter(fits).select(F.least("p", "i").alias("x"), F.greatest("p", "i").alias("y"))
             for a, b in ((beside, F.lit(True)), (main, beside))]
    more = checked(pairs[0].unionByName(pairs[1]).distinct())
    del rest, pairs
    fs.delete(spark, kept)  # the sets themselves are not needed any more
    tidy(spark)
    return named, links.unionByName(more), grown(roots, more)


def jaccard_components(docs: DataFrame, percent: int = 85, k: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest
    id reachable by links, its own included), ``n_copies`` (rows with its set).

    A document without words is its own component; a null id never names a
    component unless every id of it is null."""
    sets, _, roots = linked_sets(docs, percent, k, id_col, text_col)
    roots = roots.withColumnRenamed("node", "set_id")
    per_set = sets.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    per_set = per_set.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = per_set.groupBy("root").agg(F.min("least").alias("component_id"))
    per_set = per_set.join(least, "root").select("set_id", "component_id", "n_copies")
    out = sets.select("doc_id", "n_shingles", "set_id").join(per_set, "set_id", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles",
                      F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))


def one_per_component(docs: DataFrame, percent: int = 85, k: int = 4, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id's (of rows
    with that id, the smallest text hash; of repeated rows, one). Documents
    without words are all kept. Columns as in ``docs``."""
    sets, _, roots = linked_sets(docs, percent, k, id_col, text_col)
    roots = roots.withColumnRenamed("node", "set_id")
    rows = (sets.filter("set_id is not null").groupBy("set_id", "doc_id", "tid").agg(F.count(F.lit(1)).alias("same"))
            .join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    picks = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tid")).alias("pick"))
    first = F.col("doc_id").eqNullSafe(F.col("pick.doc_id")) & (F.col("tid") == F.col("pick.tid"))
    marks = (rows.join(picks, "root").filter(~first | (F.col("same") > 1))
             .select(F.col("doc_id").alias("_m_id"), F.col("tid").alias("_m_tid"), first.alias("_m_kept")))
    marked = (docs.alias("d").withColumn("_m_text", F.xxhash64(F.col(text_col).cast("string")))
              .join(marks.alias("m"), F.col(f"d.{id_col}").eqNullSafe(F.col("m._m_id")) & (F.col("_m_text") == F.col("m._m_tid")), "left"))
    single = marked.filter("_m_kept is null").select(*[F.col(f"d.{c}") for c in docs.columns])
    repeated = (marked.filter("_m_kept").dropDuplicates(["_m_id", "_m_tid"])
                .select(*[F.col(f"d.{c}") for c in docs.columns]))
    return single.unionByName(repeated)


__all__ = ["Bands", "allocate", "components", "jaccard_links", "linked_sets", "jaccard_components", "one_per_component"]
