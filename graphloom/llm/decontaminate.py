"""Operator 6: benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (A-Z lower-cased;
ASCII letters, digits and everything non-ASCII belong to words). Items that
share enough word windows (seeds) with a document are tiled against it:
again and again the longest match that overlaps no earlier tile is marked,
found by Karp-Rabin hashes of shrinking length. The share of an item's words
under tiles is its coverage; order does not matter, so reordered passages
are caught too.

The benchmark is the query set: it is read in blocks of bounded size, each
block goes once over all documents. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .shared import bounded_batches

MIN_MATCH = 4
COVERAGE = 0.5
BLOCK_BYTES = 32 << 20


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the first word of each text."""
    raw, offs = T.buffers(column)
    starts, ends, first = T.word_spans(raw, offs, T.ALNUM)
    return T.span_hashes(raw, starts, ends, lower=True), first


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (item word, doc word, length) of two word sequences, longest
    first; among equally long matches the first in the item, then in the
    document. Each word is under at most one tile; no tile is shorter than
    ``min(min_match, len(item))``."""
    min_match = min(min_match, len(item))
    free_a, free_b = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    size = len(item)
    while size >= max(1, min_match):
        match = _longest(item, doc, free_a, free_b, size)
        if match is None:
            if size == min_match:
                break
            size = max(min_match, size // 2)
            continue
        i, j, n = match
        free_a[i:i + n] = False
        free_b[j:j + n] = False
        tiles.append(match)
    return tiles


def _windows(h: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and running hashes of the unmarked windows of ``size`` words."""
    blocked = np.r_[0, np.cumsum(~free)]
    at = np.flatnonzero(blocked[size:] == blocked[:-size]) if len(h) >= size else np.zeros(0, np.int64)
    p, inv = T.power_tables(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[:len(h)], out=run[1:])
    return at, (run[at + size] - run[at]) * inv[at]


PAIRS = 1 << 20     # window pairs held at a time


def _longest(a, b, free_a, free_b, size) -> tuple[int, int, int] | None:
    """The longest unmarked match of at least ``size`` words.

    Equal windows are paired a slice of the item at a time, about ``PAIRS``
    pairs (or one window's) of them; matches that reach the end of a slice go
    on in the next one, diagonal by diagonal."""
    at_a, ha = _windows(a, free_a, size)
    at_b, hb = _windows(b, free_b, size)
    if not len(at_a) or not len(at_b):
        return None
    order = np.argsort(hb, kind="stable")
    lo, hi = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    some = hi > lo
    at_a, lo, n = at_a[some], lo[some], (hi - lo)[some]
    upto = np.cumsum(n)
    best: tuple[int, int, int] | None = None
    none = np.zeros(0, np.int64)
    open_at, open_diag, open_begin = -1, none, none     # matches that reach window ``open_at``
    k = 0
    while k < len(at_a):
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS, "right")))
        m = n[k:end]
        i = np.repeat(at_a[k:end], m)
        j = at_b[order[np.arange(int(m.sum())) + np.repeat(lo[k:end] - (np.cumsum(m) - m), m)]]
        # Hash matches of consecutive windows on one diagonal are one longer match.
        by = np.lexsort((i, j - i))
        i, j = i[by], j[by]
        new = np.r_[True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(i)] - 1
        begin, diag = i[first].copy(), (j - i)[first]
        if len(open_diag):
            e = np.minimum(np.searchsorted(open_diag, diag), len(open_diag) - 1)
            goes_on = (open_diag[e] == diag) & (begin == open_at + 1)
            begin[goes_on] = open_begin[e[goes_on]]
        best = _better(a, b, best, begin, begin + diag, i[last] - begin + size, size)
        open_at = int(at_a[end - 1])
        reach = i[last] == open_at
        open_diag, open_begin = diag[reach], begin[reach]   # ascending, as runs are sorted by diagonal
        k = end
    return best


def _better(a, b, best, x, y, length, size):
    """The better of ``best`` and the longest of the matches; the words decide,
    as a window hash may lie: then what is equal of that one match counts."""
    rank = lambda m: (-m[2], m[0], m[1])
    could = np.flatnonzero(length >= (best[2] if best else size))
    for r in could[np.lexsort((y[could], x[could], -length[could]))]:
        match = (int(x[r]), int(y[r]), int(length[r]))
        if best and rank(match) >= rank(best):
            break
        same = np.r_[False, a[match[0]:match[0] + match[2]] == b[match[1]:match[1] + match[2]], False]
        turns = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
            part = (match[0] + s, match[1] + s, e - s)
            if part[2] >= size and (best is None or rank(part) < rank(best)):
                best = part
    return best


class Items:
    """A block of benchmark items with an index of their seed windows."""

    def __init__(self, ids: list, texts: pa.Array, min_match: int, coverage: float):
        self.ids, self.min_match, self.coverage = ids, min_match, coverage
        self.words, self.first = word_hashes(texts)
        self.size = np.diff(self.first)
        self.index = {}
        width = np.minimum(self.size, min_match)
        for k in np.unique(width[width > 0]):
            k = int(k)
            grams = T.combine(self.words, k)
            rows, at = [], []
            for r in np.flatnonzero(width == k):
                at.append(np.arange(self.first[r], self.first[r + 1] - k + 1))
                rows.append(np.full(len(at[-1]), r))
            at, rows = np.concatenate(at), np.concatenate(rows)
            order = np.argsort(grams[at], kind="stable")
            seed, begin = np.unique(grams[at][order], return_index=True)
            filt = np.zeros(1 << 20, bool)
            filt[(seed & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.index[k] = (seed, np.r_[begin, len(order)], rows[order], (at - self.first[rows])[order], filt)

    def suspects(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(document, item) pairs whose shared seeds could cover enough of the item."""
        out = [np.zeros((0, 2), np.int64)]
        for k, (seed, begin, rows, at, filt) in self.index.items():
            grams = T.combine(words, k)
            pos = np.flatnonzero(filt[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
            e = np.minimum(np.searchsorted(seed, grams[pos]), len(seed) - 1)
            hit = seed[e] == grams[pos]
            pos, e = pos[hit], e[hit]
            doc = np.searchsorted(first, pos, side="right") - 1
            inside = pos + k <= first[doc + 1]
            doc, e = doc[inside], e[inside]
            once = np.unique(doc * len(seed) + e)  # a seed of a document counts once
            doc, e = once // len(seed), once % len(seed)
            n = begin[e + 1] - begin[e]
            if not n.sum():
                continue
            p = np.arange(int(n.sum())) + np.repeat(begin[e] - (np.cumsum(n) - n), n)
            d, r, q = np.repeat(doc, n), rows[p], at[p]
            by = np.lexsort((q, r, d))
            d, r, q = d[by], r[by], q[by]
            new = np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])]
            gap = np.r_[np.where(new[1:], k, q[1:] - q[:-1]), k]
            head = np.flatnonzero(new)
            cover = np.add.reduceat(np.minimum(gap, k), head)
            ok = cover >= self.coverage * self.size[r[head]] - 1e-9
            out.append(np.stack([d[head[ok]], r[head[ok]]], 1))
        return np.concatenate(out)

    def found(self, column: pa.Array) -> list[tuple]:
        """(row, item, tiles) of the documents of a column that an item leaked into."""
        words, first = word_hashes(column)
        out = []
        for d, r in self.suspects(words, first):
            item = self.words[self.first[r]:self.first[r + 1]]
            tiles = greedy_tiles(item, words[first[d]:first[d + 1]], self.min_match)
            if sum(t[2] for t in tiles) >= self.coverage * len(item) - 1e-9:
                out.append((int(d), int(r), tiles))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, min_match: int, coverage: float, block_bytes: int):
    """The distinct items of the benchmark in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-int(total) // block_bytes)
    for b in range(n):
        rows = sorted(items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect(), key=lambda r: (str(r["i"]), r["t"]))
        if rows:
            yield Items([r["i"] for r in rows], pa.array([r["t"] for r in rows], pa.string()), min_match, coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per (document, item) whose coverage reaches the threshold:
    id, item id, n_tiles, covered (words), item_words, coverage and the tiles
    (item word, document word, words).

    Null or wordless texts and items give no row; repeated documents give
    their rows each; repeated items count once; an item shorter than
    ``min_match`` words must stand whole; an empty table gives no rows; other
    columns, whatever their names, are not read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = (f"doc_id {dict(src.dtypes)['doc_id']}, item_id string, n_tiles int, covered int, "
              "item_words int, coverage double, tiles array<struct<item_word:int,doc_word:int,words:int>>")
    arrow = pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, item_text, min_match, coverage, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for part in T.slices(batch, "text"):
                    hits = items.found(part.column(1))
                    covered = [sum(t[2] for t in tiles) for _, _, tiles in hits]
                    size = [int(items.size[r]) for _, r, _ in hits]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([d for d, _, _ in hits], pa.int64())),
                         pa.array([None if items.ids[r] is None else str(items.ids[r]) for _, r, _ in hits], pa.string()), pa.array([len(t) for _, _, t in hits], pa.int32()),
                         pa.array(covered, pa.int32()), pa.array(size, pa.int32()),
                         pa.array([c / s for c, s in zip(covered, size, strict=True)], pa.float64()),
                         pa.array([[dict(zip(("item_word", "doc_word", "words"), x, strict=True)) for x in t] for _, _, t in hits], pa.list_(arrow))],
                        names=["doc_id", "item_id", "n_tiles", "covered", "item_words", "coverage", "tiles"])

        out = out.unionByName(src.mapInArrow(run, schema))
    out = out.withColumn("item_id", F.col("item_id").cast(dict(benchmark.dtypes)[item_col]))
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                      text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that any benchmark item leaked into.

    Null or wordless texts and repeated rows stay as they are, all columns stay
    (none is added, so no name can clash); an empty benchmark drops nothing, an
    empty table stays empty."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    bounded_batches(spark)
    for items in _blocks(benchmark, item_col, item_text, min_match, coverage, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in T.slices(batch, at):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, _, _ in shared.value.found(part.column(at))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
