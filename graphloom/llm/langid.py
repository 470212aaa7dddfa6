"""Operator 2: language identification with a byte-level bidirectional GRU.

The network reads words (runs without space and \\x09-\\x0D, cut into
pieces of at most ``PIECE_BYTES``) byte by byte in both directions and gives
every byte position a probability for each language; a document's
probabilities pool the log-probabilities of all its positions (their
geometric mean, normalised). It is trained in numpy by backpropagation
through time on a bounded, documented sample of labelled rows; prediction
covers whole texts and reads each distinct word of a slice once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnp as T
from .shared import bounded_batches

PIECE_BYTES = 32
SLICE = 4 << 20
CACHE_WORDS = 250_000
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Bidirectional GRU over bytes with a softmax at every position."""

    def __init__(self, langs: list[str], hidden: int = 16, seed: int = 7):
        rng, h, c = np.random.default_rng(seed), hidden, len(langs)
        self.langs, self.h = langs, h
        self.p = {"bias": np.zeros(c, np.float32)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.p["b" + d] = np.zeros(3 * h, np.float32)
            self.p["o" + d] = rng.normal(0, 1 / np.sqrt(h), (h, c)).astype(np.float32)

    def _read(self, d: str, seq: np.ndarray, keep: bool = False):
        """States after each byte of equally long sequences (n, len)."""
        h, u = self.h, self.p["u" + d]
        table = self.p["x" + d] + self.p["b" + d]
        s = np.zeros((len(seq), h), np.float32)
        out, tape = [], []
        for t in range(seq.shape[1]):
            x, g = table[seq[:, t]], s @ u
            zr = _sigmoid(x[:, :2 * h] + g[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[:, 2 * h:] + r * g[:, 2 * h:])
            new = n + z * (s - n)
            if keep:
                tape.append((s, z, r, n, g[:, 2 * h:]))
            out.append(new)
            s = new
        return out, tape

    def log_probs(self, seq: np.ndarray) -> np.ndarray:
        """Log-probabilities (n, len, languages) of equally long byte sequences."""
        f, _ = self._read("f", seq)
        b, _ = self._read("b", seq[:, ::-1])
        return _log_softmax(np.stack(f, 1) @ self.p["of"] + np.stack(b[::-1], 1) @ self.p["ob"] + self.p["bias"])

    def gradients(self, seq: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradients (backpropagation through time)."""
        n, length = seq.shape
        grads: dict[str, np.ndarray] = {}
        states, tapes = {}, {}
        for d, s in (("f", seq), ("b", seq[:, ::-1])):
            states[d], tapes[d] = self._read(d, s, keep=True)
        hidden = {"f": np.stack(states["f"], 1), "b": np.stack(states["b"][::-1], 1)}
        logp = _log_softmax(hidden["f"] @ self.p["of"] + hidden["b"] @ self.p["ob"] + self.p["bias"])
        loss = -float(logp[np.arange(n), :, label].mean())
        err = np.exp(logp)
        err[np.arange(n), :, label] -= 1
        err /= n * length
        grads["bias"] = err.sum((0, 1))
        for d in "fb":
            key = "o" + d
            grads[key] = np.einsum("nth,ntc->hc", hidden[d], err)
            back = err @ self.p[key].T
            order = seq if d == "f" else seq[:, ::-1]
            if d == "b":
                back = back[:, ::-1]
            self._unroll(d, order, back, tapes[d], grads)
        return loss, grads

    def _unroll(self, d: str, seq, back, tape, grads) -> None:
        h, u = self.h, self.p["u" + d]
        gx, gu, gb = np.zeros_like(self.p["x" + d]), np.zeros_like(u), np.zeros(3 * h, np.float32)
        carry = np.zeros((len(seq), h), np.float32)
        for t in reversed(range(seq.shape[1])):
            s, z, r, n, gn = tape[t]
            ds = back[:, t] + carry
            dn = ds * (1 - z) * (1 - n * n)
            dz = ds * (s - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], 1)
            dg = np.concatenate([dz, dr, dn * r], 1)
            np.add.at(gx, seq[:, t], dx)
            gb += dx.sum(0)
            gu += s.T @ dg
            carry = ds * z + dg @ u.T
        grads["x" + d], grads["u" + d], grads["b" + d] = gx, gu, gb


def _log_softmax(x):
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def pools(counts: pa.Table, langs: list[str]) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Training words by length and language: bytes (words, length) and
    weights, from a table (lang, piece, count). Only arrays are made."""
    counts = counts.sort_by([("lang", "ascending"), ("piece", "ascending")])
    out: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for k, lang in enumerate(langs):
        part = counts.filter(pa.compute.equal(counts.column("lang"), lang)).combine_chunks()
        raw, offs = T.buffers(part.column("piece").cast(pa.large_binary()))
        weight, size = part.column("count").to_numpy().astype(float), np.diff(offs)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            out.setdefault(int(n), {})[k] = (raw[offs[rows][:, None] + np.arange(n)], weight[rows])
    return out


def train(words: list[tuple[bytes, int, float]] | dict, langs: list[str], steps: int = 500, batch: int = 384,
          hidden: int = 16, rate: float = 0.02, seed: int = 7) -> ByteGRU:
    """Fit the network on (word, language index, weight) rows, or on
    :func:`pools` of them, by Adam.

    Every step draws one word length and words of that length (and only then
    a language, evenly), so sequences need no padding. Same rows, same model."""
    net, rng = ByteGRU(langs, hidden, seed), np.random.default_rng(seed)
    if not isinstance(words, dict):
        words = pools(pa.table({"lang": [langs[k] for _, k, _ in words], "piece": pa.array([w for w, _, _ in words], pa.binary()), "count": [n for _, _, n in words]}), langs)
    lengths = sorted(words)
    mass = np.array([sum(p.sum() for _, p in words[n].values()) * n for n in lengths], dtype=float)
    pool = {n: {k: (w, p / p.sum()) for k, (w, p) in x.items()} for n, x in words.items()}
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        n = lengths[rng.choice(len(lengths), p=mass / mass.sum())]
        seq, label = [], []
        for k, (w, p) in pool[n].items():
            take = max(1, batch // len(pool[n]))
            seq.append(w[rng.choice(len(w), take, p=p)])
            label += [k] * take
        _, grads = net.gradients(np.concatenate(seq), np.array(label))
        lr = rate * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - lr * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def _pieces(raw, offs):
    """Spans of words cut into pieces, and the first piece of each text."""
    starts, ends, first = T.word_spans(raw, offs)
    parts = (ends - starts + PIECE_BYTES - 1) // PIECE_BYTES
    if len(parts) and parts.max() > 1:
        at = np.cumsum(parts) - parts
        k = np.arange(int(parts.sum())) - np.repeat(at, parts)
        s = np.repeat(starts, parts) + k * PIECE_BYTES
        ends = np.minimum(np.repeat(ends, parts), s + PIECE_BYTES)
        starts, first = s, np.r_[at, parts.sum()][first]
    return starts, ends, first


def word_scores(net: ByteGRU, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Summed log-probabilities of each span's positions (spans, languages)."""
    out = np.zeros((len(starts), len(net.langs)), np.float32)
    size = ends - starts
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for i in range(0, len(rows), 2048):
            r = rows[i:i + 2048]
            out[r] = net.log_probs(raw[starts[r][:, None] + np.arange(n)]).sum(1)
    return out


class Scorer:
    """Document probabilities; each distinct word is read once, and scores of
    recent words are kept (at most about ``CACHE_WORDS``)."""

    def __init__(self, net: ByteGRU):
        self.net = net
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(net.langs)), np.float32)

    def documents(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        starts, ends, first = _pieces(raw, offs)
        h = T.span_hashes(raw, starts, ends)
        kinds, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, kinds), max(0, len(self.known) - 1))
        old = self.known[at] == kinds if len(self.known) else np.zeros(len(kinds), bool)
        scores = np.empty((len(kinds), len(self.net.langs)), np.float32)
        scores[old] = self.scores[at[old]]
        new = index[~old]
        scores[~old] = word_scores(self.net, raw, starts[new], ends[new])
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.scores = kinds[:CACHE_WORDS], scores[:CACHE_WORDS]
        elif len(new):
            known = np.concatenate([self.known, kinds[~old]])
            order = np.argsort(known, kind="stable")  # two sorted runs
            self.known, self.scores = known[order], np.concatenate([self.scores, scores[~old]])[order]
        total = np.zeros((len(offs) - 1, scores.shape[1]))
        for c in range(scores.shape[1]):
            run = np.r_[0.0, np.cumsum(scores[inverse, c], dtype=np.float64)]
            total[:, c] = run[first[1:]] - run[first[:-1]]
        count = np.r_[0, np.cumsum(ends - starts)]
        mean = total / np.maximum(1, count[first[1:]] - count[first[:-1]])[:, None]
        return np.exp(_log_softmax(mean))


_SCORERS: dict[str, Scorer] = {}


def worker_scorer(net: ByteGRU) -> Scorer:
    """The scorer of a Python worker: its words stay known between tasks of one model."""
    digest = hashlib.sha256(b"".join(net.p[k].tobytes() for k in sorted(net.p))).hexdigest()
    if digest not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[digest] = Scorer(net)
    return _SCORERS[digest]


def position_labels(net: ByteGRU, text: str) -> list[tuple[int, int, str]]:
    """Runs (start byte, end byte, language) of equal labels over the word
    bytes of a whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = _pieces(raw, np.array([0, len(raw)]))
    out: list[list] = []
    for s, e in zip(starts, ends, strict=True):
        for i, c in enumerate(net.log_probs(raw[None, s:e])[0].argmax(-1)):
            if out and out[-1][1] == s + i and out[-1][2] == net.langs[c]:
                out[-1][1] += 1
            else:
                out.append([int(s) + i, int(s) + i + 1, net.langs[c]])
    return [tuple(x) for x in out]


def _lettered(texts: pa.Array) -> np.ndarray:
    return np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)


def held_out(id_col: str = "doc_id"):
    """True for a fifth of the rows, by crc32 of the id's decimal text (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500,
        per_lang_bytes: int = 2_000_000, max_langs: int = 256, **training) -> ByteGRU:
    """Train on labelled rows outside the held-out fifth.

    Bound of the sample (the driver gets only its word counts): for each
    language the ``per_lang`` documents with the smallest id hash, of which
    whole texts are taken while they sum to at most ``per_lang_bytes``; at
    most ``max_langs`` languages, the most frequent ones, are learned."""
    rows = docs.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                       F.xxhash64(id_col, F.lit(11)).alias("h"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    # Cut by a hash threshold first: about twice the bound stays, so the ranking sorts few rows.
    share = sizes.select("lang", (F.lit(2.0 * per_lang) / F.col("count")).alias("share"))
    near = rows.join(F.broadcast(share), "lang").filter((F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)) | (F.col("share") >= 1)).filter("text is not null")
    order = Window.partitionBy("lang").orderBy("h", "text")
    picked = (near.withColumn("r", F.row_number().over(order))
              .withColumn("b", F.sum(F.octet_length("text")).over(order)).filter((F.col("r") <= per_lang) & ((F.col("b") <= per_lang_bytes) | (F.col("r") == 1))))
    piece = F.expr(f"explode(transform(sequence(0, (octet_length(w) - 1) div {PIECE_BYTES}), i -> substring(encode(w, 'utf-8'), i * {PIECE_BYTES} + 1, {PIECE_BYTES})))")
    counts = (picked.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).filter("w <> ''")
              .select("lang", piece.alias("piece")).groupBy("lang", "piece").count().toArrow())
    langs = sorted(counts.column("lang").unique().to_pylist())
    if not langs:
        return ByteGRU([])
    words = pools(counts, langs)
    del counts
    net = train(words, langs, **training)
    del words
    T.release()
    return net


def predict(docs: DataFrame, net: ByteGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (probability of
    that language). ``und`` with score 0 for a null text, a text without a
    letter, or a network without languages. Repeated rows and ids keep their
    rows; other columns are not read."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(net)
        names = np.array([*net.langs, "und"], dtype=object)
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                texts = part.column(1)
                letters = _lettered(texts)
                best, score = np.full(len(letters), len(net.langs)), np.zeros(len(letters))
                if net.langs and letters.any():
                    probs = scorer.documents(*T.buffers(texts))
                    best = np.where(letters, probs.argmax(1), best)
                    # Single floats add up a little differently in batches of another size.
                    score = np.where(letters, np.round(probs.max(1).astype(float), 6), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    out = src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, lang_pred string, score double")
    return out.withColumnRenamed("doc_id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """Train and predict: id, ``held_out``, ``lang_pred``, ``score``."""
    net = fit(docs, id_col, text_col, lang_col, **bounds)
    return predict(docs, net, id_col, text_col).select(F.col(id_col), held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, net: ByteGRU, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or scores below ``min_score``.

    Null texts and texts without a letter go, a network without languages keeps
    nothing; repeated rows are judged each; all columns stay (none is added, so
    no name can clash); an empty table stays empty."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(net)
        for batch in batches:
            for part in T.slices(batch, at, SLICE):
                keep = _lettered(part.column(at))
                if net.langs and keep.any():
                    keep &= scorer.documents(*T.buffers(part.column(at))).max(1) >= min_score
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
