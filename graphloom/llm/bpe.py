"""Operator 10: byte-level BPE encoding by speculation, and decoding.

Texts are split into pieces by the byte-level pattern with numpy (character
classes of whole slices at once); each distinct piece of a slice is encoded
once:

1. *Speculate*: a trie walked for all pieces together proposes the greedy
   longest-match tokens.
2. *Verify*: for every adjacent token pair a vectorised check tells whether
   the merge rules keep the border between them. A sequence whose adjacent
   pairs are all compatible is the exact encoding.
3. *Repair*: only pieces with a failing pair are merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .shared import bounded_batches

SLICE = 3 << 20
CACHE_PIECES = 400_000

NO_MERGE = 1 << 40
LONG_PIECE = 64  # longer pieces are merged one by one, with a heap

# Character classes of the split pattern.
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point, by the regex library's own properties."""
    table = np.zeros(0x110000, np.uint8)
    for code, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for start in range(0, 0x110000, 0x10000):
            points = [chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(start, start + 0x10000)]
            for m in regex.finditer(pattern, "".join(points)):
                table[start + m.start():start + m.end()] = code
    return table


def _byte_letters() -> dict[str, int]:
    """The printable stand-in letter of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge rules and lookup tables of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letter = spec["model"], _byte_letters()
        as_bytes = lambda s: bytes(letter[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for s, i in model["vocab"].items():
            self.tokens[i] = as_bytes(s)
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items()}
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        # rank of a merge and the token it makes, by the pair of token ids
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1: a single byte
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ia, ib = model["vocab"][a], model["vocab"][b]
            made = model["vocab"][a + b]
            self.merges.setdefault((ia, ib), (r, made))
            if self.rank[made] < 0 and len(self.tokens[made]) > 1:
                self.left[made], self.right[made], self.rank[made] = ia, ib, r
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.made = np.zeros(len(model["merges"]), np.int64)
        for r, made in self.merges.values():
            self.made[r] = made
        self.size = size
        self._build_trie()
        # Tokens that the rules themselves never produce are not proposed.
        self.reachable = np.array([i in (self.exact(t) if t and i not in self.special.values() else [None])[:1]
                                   and len(self.exact(t)) == 1 for i, t in enumerate(self.tokens)])
        self.token_at = np.where(np.r_[self.reachable, False][self.token_at], self.token_at, -1)

    def _build_trie(self) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        edge_key, edge_to, at = [], [], [-1]
        for t in sorted(self.ids):
            for i in range(1, len(t) + 1):
                if t[:i] not in nodes:
                    nodes[t[:i]] = len(nodes)
                    at.append(-1)
                    edge_key.append(nodes[t[:i - 1]] * 256 + t[i - 1])
                    edge_to.append(nodes[t[:i]])
            at[nodes[t]] = self.ids[t]
        order = np.argsort(edge_key)
        self.edge_key, self.edge_to = np.array(edge_key)[order], np.array(edge_to)[order]
        self.token_at = np.array(at)
        # The first two bytes by table, deeper steps by binary search.
        self.root = np.full(256, -1, np.int64)
        first = self.edge_key < 256
        self.root[self.edge_key[first]] = self.edge_to[first]

    def exact(self, piece: bytes) -> list[int]:
        """The piece's tokens by applying the merge rules, lowest rank first, leftmost first."""
        ids = [int(self.byte_id[b]) for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.merges[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i] = self.merges[pair][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := (ids[i], ids[after[j]])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], i, p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in self.merges:
                heapq.heappush(heap, (self.merges[p][0], before[i], p))
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each token pair; ``NO_MERGE`` if there is none."""
        key = a * self.size + b
        e = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[e] == key, self.pair_rank[e], NO_MERGE)

    def exact_rows(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`exact` for many short spans at once: (span of each token,
        token). In every round each span merges its lowest, leftmost pair."""
        size = ends - starts
        row = np.repeat(np.arange(len(starts)), size)
        token = self.byte_id[raw[np.arange(len(row)) + np.repeat(starts - (np.cumsum(size) - size), size)]]
        rank = np.full(len(row), NO_MERGE, np.int64)
        inner = np.flatnonzero(row[1:] == row[:-1])
        rank[inner] = self.ranks(token[inner], token[inner + 1])
        done = []
        while len(row):
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            length = np.diff(np.r_[begin, len(row)])
            low = np.minimum.reduceat(rank, begin)
            ended = np.repeat(low == NO_MERGE, length)
            done.append((row[ended], token[ended]))
            lowest = np.repeat(low, length)
            row, token, rank, lowest = row[~ended], token[~ended], rank[~ended], lowest[~ended]
            at = np.flatnonzero(rank == lowest)
            at = at[np.r_[True, row[at[1:]] != row[at[:-1]]]] if len(at) else at
            token[at] = self.made[rank[at]]
            keep = np.ones(len(row), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            row, token, rank = row[keep], token[keep], rank[keep]
            rank[at] = NO_MERGE
            nxt = at[at + 1 < len(row)]
            nxt = nxt[row[nxt] == row[nxt + 1]]
            rank[nxt] = self.ranks(token[nxt], token[nxt + 1])
            prv = at[at > 0] - 1
            prv = prv[row[prv] == row[prv + 1]]
            rank[prv] = self.ranks(token[prv], token[prv + 1])
        rows, tokens = (np.concatenate([x[i] for x in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(rows, kind="stable")
        return rows[order], tokens[order]

    def propose(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all spans: (piece of each token,
        token), in order."""
        rows, found = [], []
        live, at = np.arange(len(starts)), starts.copy()
        live = live[starts < ends]
        while len(live):
            pos = at[live]
            stop = ends[live]
            state = self.root[raw[pos]]
            best = self.byte_id[raw[pos]].copy()
            length = np.ones(len(live), np.int64)
            walk, depth = np.arange(len(live)), 1
            while len(walk):
                walk = walk[pos[walk] + depth < stop[walk]]
                if not len(walk):
                    break
                key = state[walk] * 256 + raw[pos[walk] + depth]
                e = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
                ok = self.edge_key[e] == key
                walk, e = walk[ok], e[ok]
                depth += 1
                state[walk] = self.edge_to[e]
                token = self.token_at[state[walk]]
                hit = token >= 0
                best[walk[hit]] = token[hit]
                length[walk[hit]] = depth
            rows.append(live)
            found.append(best)
            at[live] += length
            live = live[at[live] < ends[live]]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, token = np.concatenate(rows), np.concatenate(found)
        order = np.argsort(row, kind="stable")  # rounds are in order already
        return row[order], token[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For token pairs: do the merge rules keep the border between them?

        Both tokens are taken apart from their last merge backwards, always
        the later merge first; whenever the two parts that touch the border
        would have merged before the merge just undone, the border falls."""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        # Ranks of the merges just undone beside the border: a border merge has to come
        # before them (on the left side ties go to the leftmost pair, the left one).
        limit = np.full(len(a), NO_MERGE, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            fall = self.ranks(x, y) * 2 + 1 < limit[live]
            good[live[fall]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~fall & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            # The left token's merge sits left of the border: at equal rank it comes first.
            left = rx > ry
            limit[live] = np.where(left, rx * 2, ry * 2 + 2)
            a[live] = np.where(left, self.right[x], x)
            b[live] = np.where(left, y, self.left[y])
        return good


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def split_pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of the pieces of all texts (none crosses a text border)
    and the first piece of each text.

    The pattern's pieces: a contraction after an apostrophe; an optional
    space and a run of letters, of numbers or of other characters; white
    space, whose last character is left to the following piece."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    head = (raw & 0xC0) != 0x80  # first byte of a character
    at = np.flatnonzero(head)
    lead = raw[at]
    code = lead.astype(np.uint32)
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        p, l0 = at[wide], lead[wide].astype(np.uint32)
        byte = lambda k: raw[np.minimum(p + k, n - 1)].astype(np.uint32) & 0x3F
        two = (l0 & 0x1F) << 6 | byte(1)
        three = (l0 & 0x0F) << 12 | byte(1) << 6 | byte(2)
        four = (l0 & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)
        code[wide] = np.where(l0 < 0xE0, two, np.where(l0 < 0xF0, three, four))
    kind = _classes()[np.minimum(code, 0x10FFFF)]
    c = len(at)
    border = np.zeros(c + 1, bool)  # first character of a text
    border[np.searchsorted(at, offs[:-1][offs[:-1] < n])] = True
    border[c] = True
    start = np.empty(c, bool)  # a piece starts at this character
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= border[:-1]
    space = kind == _SPACE
    blank = code == 0x20
    nxt_border = border[1:]
    # The last white space before another character: its own piece; a blank joins what follows.
    last_ws = space.copy()
    last_ws[:-1] &= ~space[1:]
    last_ws[-1] = False
    last_ws &= ~nxt_border
    start |= last_ws
    follows = np.zeros(c, bool)
    follows[1:] = last_ws[:-1] & blank[:-1]
    start &= ~(follows & ~border[:-1])
    # Contractions: an apostrophe that starts a piece, then one of the endings.
    quote = np.flatnonzero((code == 0x27) & start)
    if len(quote):
        same = lambda k, ch: (quote + k < c) & (code[np.minimum(quote + k, c - 1)] == ord(ch))
        room = lambda k: ~_any_border(border, quote, k, c)
        one = (same(1, "s") | same(1, "t") | same(1, "m") | same(1, "d")) & room(1)
        two = ((same(1, "r") & same(2, "e")) | (same(1, "v") & same(2, "e")) | (same(1, "l") & same(2, "l"))) & room(2)
        size = np.where(one, 1, np.where(two, 2, 0))
        for k in (1, 2):
            inside = quote[size >= k] + k
            start[inside] = False
        end = quote[size > 0] + size[size > 0] + 1
        end = end[end < c]
        # What follows a contraction starts anew (white space keeps its own rule).
        start[end] = True
        # An apostrophe right behind the contraction begins a piece that may contract as well.
    starts = at[start]
    return starts, np.searchsorted(starts, offs)


def _any_border(border: np.ndarray, at: np.ndarray, k: int, c: int) -> np.ndarray:
    out = np.zeros(len(at), bool)
    for j in range(1, k + 1):
        out |= border[np.minimum(at + j, c)]
    return out


class Encoder:
    """Encodes slices of texts; tokens of recent pieces are kept."""

    cache = CACHE_PIECES

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.known = np.zeros(0, np.uint64)
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.repaired = self.proposed = 0

    def _encode_pieces(self, raw, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each span, concatenated, with their borders."""
        v = self.v
        row, token = v.propose(raw, starts, ends)
        self.proposed += len(starts)
        pair = np.flatnonzero(row[1:] == row[:-1])
        key = token[pair] * v.size + token[pair + 1]
        kinds, inverse = np.unique(key, return_inverse=True)
        good = v.compatible(kinds // v.size, kinds % v.size)[inverse]
        failed = np.unique(row[pair[~good]])
        count = np.bincount(row, minlength=len(starts))
        if len(failed):
            self.repaired += len(failed)
            long = ends[failed] - starts[failed] > LONG_PIECE
            short = failed[~long]
            r, t = v.exact_rows(raw, starts[short], ends[short])
            fixed = [(short[r], t)]
            for i in failed[long]:
                ids = np.array(v.exact(raw[starts[i]:ends[i]].tobytes()), np.int64)
                fixed.append((np.full(len(ids), i), ids))
            bad = np.zeros(len(starts), bool)
            bad[failed] = True
            keep = ~bad[row]
            row = np.concatenate([row[keep], *(x for x, _ in fixed)])
            token = np.concatenate([token[keep], *(x for _, x in fixed)])
            order = np.argsort(row, kind="stable")
            row, token = row[order], token[order]
            count = np.bincount(row, minlength=len(starts))
        return token.astype(np.int32), np.r_[0, np.cumsum(count)]

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, concatenated, with the border of each text."""
        starts, first = split_pieces(raw, offs)
        ends = np.r_[starts[1:], len(raw)] if len(starts) else starts
        h = T.span_hashes(raw, starts, ends)
        kinds, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, kinds), max(0, len(self.known) - 1))
        old = self.known[at] == kinds if len(self.known) else np.zeros(len(kinds), bool)
        new = index[~old]
        order = np.argsort(new)
        made, border = self._encode_pieces(raw, starts[new][order], ends[new][order])
        back = np.empty(len(new), np.int64)
        back[order] = np.arange(len(new))
        # One table of the pieces of this slice: begin and length of their tokens.
        pool = np.concatenate([self.ids, made])
        begin, size = np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64)
        begin[old], size[old] = self.begin[at[old]], self.count[at[old]]
        begin[~old] = len(self.ids) + border[:-1][back]
        size[~old] = np.diff(border)[back]
        out = _gather(pool, begin[inverse], size[inverse])
        count = np.r_[0, np.cumsum(size[inverse])]
        self._remember(kinds, pool, begin, size, old)
        return out, count[first]

    def _remember(self, kinds, pool, begin, size, old) -> None:
        if len(self.known) + int((~old).sum()) > self.cache:
            keep = slice(0, self.cache)  # start again from this slice's pieces
            self.known, self.count = kinds[keep], size[keep]
            self.ids = _gather(pool, begin[keep], self.count)
            self.begin = np.cumsum(self.count) - self.count
        elif not old.all():
            keys = np.concatenate([self.known, kinds[~old]])
            order = np.argsort(keys, kind="stable")  # two sorted runs
            self.known, self.ids = keys[order], pool
            self.begin = np.concatenate([self.begin, begin[~old]])[order]
            self.count = np.concatenate([self.count, size[~old]])[order]


@functools.lru_cache(maxsize=2)
def worker_encoder(path: str) -> Encoder:
    """The encoder of a Python worker: its pieces stay known between tasks."""
    return Encoder(path)


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of ``pool[begin:begin+size]`` of all rows."""
    total = int(size.sum())
    if not total:
        return pool[:0]
    end = np.cumsum(size)
    index = np.arange(total, dtype=np.int64) + np.repeat(begin - (end - size), size)
    return pool[index]


def with_special(encoder: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Encode texts in which strings of special tokens stand for these tokens."""
    raw, offs = T.buffers(texts)
    special = encoder.v.special
    whole = raw.tobytes() if special else b""
    hits = regex.finditer(b"|".join(regex.escape(s.encode()) for s in sorted(special, key=len, reverse=True)), whole) \
        if any(s.encode() in whole for s in special) else []
    cuts = [(m.start(), m.end(), special[m[0].decode()]) for m in hits]
    cuts = [x for x in cuts if np.searchsorted(offs, x[0], side="right") == np.searchsorted(offs, x[1], side="left")]
    if not cuts:
        return encoder.encode(raw, offs)
    # Cut the texts around the special strings, encode the rest, put the tokens between.
    edges = np.unique(np.concatenate([offs, [p for s, e, _ in cuts for p in (s, e)]]))
    ids, border = encoder.encode(raw, edges)
    inside = {int(np.searchsorted(edges, s)): t for s, _, t in cuts}
    parts, size = [], np.diff(border)
    for i in range(len(edges) - 1):
        if i in inside:
            parts.append(np.array([inside[i]], np.int32))
            size[i] = 1
        else:
            parts.append(ids[border[i]:border[i + 1]])
    total = np.r_[0, np.cumsum(size)]
    return np.concatenate(parts), total[np.searchsorted(edges, offs)]


def decode_bytes(v: Vocabulary, ids) -> bytes:
    return b"".join(map(v.tokens.__getitem__, ids))


def decode(v: Vocabulary, ids) -> str:
    """Text of a token sequence; bytes that are no UTF-8 become U+FFFD."""
    return decode_bytes(v, ids).decode("utf-8", errors="replace")


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` (array<int>) and ``decoded`` (the
    text that the ids decode to). A null text is empty and has no ids;
    repeated rows keep their rows; other columns are not read."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocab_path)
        for part, ids, border in encoded_slices(batches, encoder):
            lists = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids, pa.int32()))
            texts = [decode(encoder.v, ids[border[i]:border[i + 1]].tolist()) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    out = src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, ids array<int>, decoded string")
    return out.withColumnRenamed("doc_id", id_col)


def encoded_slices(batches, encoder: Encoder):
    """(slice of a batch, ids of its texts, borders) over all batches."""
    for batch in batches:
        for part in T.slices(batch, "text", SLICE):
            ids, border = with_special(encoder, part.column(part.schema.get_field_index("text")))
            yield part, ids, border


def digest_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with digests in place of ids and text:
    ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256`` (UTF-8 of the decoded text)."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocab_path)
        numbers = [str(i) for i in range(encoder.v.size)]
        for part, ids, border in encoded_slices(batches, encoder):
            a, b = [], []
            for i in range(part.num_rows):
                own = ids[border[i]:border[i + 1]].tolist()
                a.append(hashlib.sha256(",".join(map(numbers.__getitem__, own)).encode()).hexdigest())
                b.append(hashlib.sha256(decode(encoder.v, own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(border), pa.int64()), pa.array(a), pa.array(b)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
