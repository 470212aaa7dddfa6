"""Distinct word-shingle sets of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textnp as T


def shingle_sets(column: pa.Array, k: int = 4):
    """Yield one sorted array of distinct shingle hashes per text.

    Words are runs without space and \\x09-\\x0D, A-Z lower-cased; a text of
    fewer than ``k`` words has its whole word sequence as one shingle; null
    or wordless texts have the empty set."""
    raw, offs = T.buffers(column)
    starts, ends, first = T.word_spans(raw, offs)
    words = T.span_hashes(raw, starts, ends, lower=True)
    grams = T.combine(words, k)
    for d in range(len(offs) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            yield T.sorted_distinct(grams[a:b - k + 1])
        elif b > a:
            yield T.mix(T.combine(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)
