"""Operator 8: license scans by fuzzy search of short notices.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased. *Phrases* are found exactly, as consecutive words. *Notices* may
differ in up to ``errors`` characters: a notice is split into ``errors + 1``
seeds, one of which must stand unchanged in any such copy (pigeonhole); the
exact seeds locate candidates in the normalised text, and the regex library's
bounded-error matching verifies the edits there and reports the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .shared import bounded_batches

SLICE = 8 << 20

# Exact phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Short notices searched with edits, and their labels (words as in the normalised text).
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the gnu general public license": "gpl",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
}
ERROR_SHARE = 0.1

_TABLE = np.full(256, 0x20, np.uint8)
_TABLE[T.ALNUM] = T.LOWER[T.ALNUM]


class Notice:
    """One notice with its seeds and its bounded-error pattern."""

    def __init__(self, text: str, label: str, share: float):
        self.text, self.label = text.encode(), label
        self.errors = int(share * len(self.text))
        cut = np.linspace(0, len(self.text), self.errors + 2).astype(int)
        self.seeds = [(int(a), self.text[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.pattern = regex.compile(b"(?e)(?:" + regex.escape(self.text) + b"){e<=%d}" % self.errors)

    def search(self, norm: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the notice's copies in normalised bytes."""
        near = []
        for at, seed in self.seeds:
            i = norm.find(seed)
            while i >= 0:
                near.append((max(0, i - at - self.errors), min(len(norm), i - at + len(self.text) + self.errors)))
                i = norm.find(seed, i + 1)
        spans, out = [], []
        for a, b in sorted(near):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        for a, b in spans:
            for line in regex.finditer(rb"[^\n]+", norm, pos=a, endpos=b):  # a line break parts documents
                for m in self.pattern.finditer(norm, pos=line.start(), endpos=line.end()):
                    if m.end() > m.start():
                        out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
        return out


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], share: float):
        self.notices = [Notice(t, label, share) for t, label in notices.items()]
        self.phrases = {}
        for text, label in phrases.items():
            words = text.split(" ")
            raw = np.frombuffer(text.encode(), np.uint8)
            s, e, _ = T.word_spans(raw, np.array([0, len(raw)]), T.ALNUM)
            key = T.combine(T.span_hashes(raw, s, e, lower=True), len(words))[0]
            self.phrases.setdefault(len(words), []).append((key, text.encode(), label))

    def scan(self, column: pa.Array):
        """Per slice: words per text, exact places (text, word, label) and
        fuzzy spans (text, first word, end word, edits, notice)."""
        raw, offs = T.buffers(column)
        starts, ends, first = T.word_spans(raw, offs, T.ALNUM)
        hashes = T.span_hashes(raw, starts, ends, lower=True)
        places, spans = [], []
        for k, wanted in self.phrases.items():
            grams = T.combine(hashes, k)
            for key, text, label in wanted:
                for w in np.flatnonzero(grams == key):
                    d = int(np.searchsorted(first, w, side="right")) - 1
                    said = b" ".join(raw[starts[i]:ends[i]].tobytes().lower() for i in range(w, w + k))
                    if w + k <= first[d + 1] and said == text:
                        places.append((d, int(w - first[d]), label))
        # Normalised bytes: words one blank apart, documents parted by a line break.
        size = ends - starts
        end = np.cumsum(size + 1)
        norm = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
        begin = end - size - 1
        inside = T.ALNUM[raw]
        body = np.ones(len(norm), bool)
        body[end - 1] = False
        norm[body] = _TABLE[raw[inside]]
        last = first[1:][first[1:] > first[:-1]] - 1
        norm[end[last] - 1] = 0x0A
        text = norm.tobytes()
        for n in self.notices:
            for a, b, edits in n.search(text):
                w0 = int(np.searchsorted(begin, a, side="right")) - 1
                w1 = int(np.searchsorted(begin, b, side="left"))
                d = int(np.searchsorted(first, w0, side="right")) - 1
                spans.append((d, w0 - int(first[d]), w1 - int(first[d]), edits, n))
        return np.diff(first), places, spans


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES,
                  error_share: float = ERROR_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base (places of phrases),
    first_word and last_word (smallest and largest start of a place, else
    null), base_labels, labels (phrases and notices; distinct, sorted,
    comma-joined), score (1 for an exact place, else the best share of
    unedited notice characters, else 0) and the fuzzy ``spans`` (label, first
    word, end word, edits).

    A null text is empty; repeated rows keep their rows; other columns are not read."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, error_share)
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                words, places, spans = scanner.scan(part.column(1))
                base: dict[int, list] = {}
                fuzzy: dict[int, list] = {}
                for d, w, label in places:
                    base.setdefault(d, []).append((w, label))
                for d, *x in spans:
                    fuzzy.setdefault(d, []).append(x)
                rows = range(part.num_rows)
                place = [base.get(d, []) for d in rows]
                score = [1.0 if base.get(d) else max((1 - x[2] / len(x[3].text) for x in fuzzy.get(d, [])), default=0.0) for d in rows]
                join = lambda labels: ",".join(sorted(set(labels)))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(words, pa.int64()), pa.array([len(x) for x in place], pa.int64()),
                    pa.array([min(x)[0] if x else None for x in place], pa.int64()),
                    pa.array([max(x)[0] if x else None for x in place], pa.int64()),
                    pa.array([join(b for _, b in x) for x in place]),
                    pa.array([join([*(b for _, b in x), *(y[3].label for y in fuzzy.get(d, []))]) for d, x in enumerate(place)]),
                    pa.array(score, pa.float64()),
                    pa.array([[{"label": n.label, "start_word": a, "end_word": b, "edits": e}
                               for a, b, e, n in sorted(fuzzy.get(d, []), key=lambda x: x[:2])] for d in rows], pa.list_(span))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    out = src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, "
                              "base_labels string, labels string, score double, "
                              "spans array<struct<label:string,start_word:long,end_word:long,edits:int>>")
    return out.withColumnRenamed("doc_id", id_col)
