"""Vectorised text helpers that run inside Spark tasks (numpy over Arrow buffers).

Every helper takes the UTF-8 bytes of many texts at once; the largest arrays
are per word, byte-level arrays are built in pieces of about ``PIECE`` bytes.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
LONG_SPAN = 64
SLICE_BYTES = 2 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = (x + _GOLD).astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Word bytes of the second word rule: ASCII letters, digits, everything non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j < n (kept between calls)."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or large binary column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]] if n else raw[:0], offs - offs[0] if n else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, text: str | int, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows with at most about ``limit`` text bytes
    (a longer text stands alone), so memory follows the longest text."""
    n = batch.num_rows
    if not n:
        return
    _, offs = buffers(batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)))
    start = 0
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end
    release()


@functools.cache
def _trim():
    """The C library's way to give free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Return memory that is free in this worker; it may idle between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def word_spans(raw: np.ndarray, offs: np.ndarray, words: np.ndarray | None = None):
    """Byte spans of the words of all texts and the first word of each text.

    ``words``: table of the bytes that belong to words; default all but
    space and \\x09-\\x0D. Returns (starts, ends, first) with
    ``first[d]:first[d+1]`` the words of text ``d``."""
    inside = ~_SPACE[raw] if words is None else words[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    if len(raw):
        edge[0] = inside[0]
        edge[1:-1] = inside[1:] & ~inside[:-1]
        cut = offs[1:-1][offs[1:-1] < len(raw)]
        edge[cut] |= inside[cut]
        starts = np.flatnonzero(edge)
        stop = np.zeros(len(raw) + 1, dtype=bool)
        stop[-1] = inside[-1]
        stop[1:-1] = inside[:-1] & ~inside[1:]
        cut = cut[cut > 0]
        stop[cut] |= inside[cut - 1]
        ends = np.flatnonzero(stop)
    else:
        starts = ends = np.zeros(0, dtype=np.int64)
    return starts, ends, np.searchsorted(starts, offs).astype(np.int64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span (spans ascending, not overlapping).

    Spans of up to ``LONG_SPAN`` bytes have a polynomial hash, taken for all at
    once. Modulo 2**64 that form has equal values for some long sequences of
    two letters, so longer spans have a blake2b digest of their bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + PIECE, side="right")))
        piece = raw[at:int(ends[j - 1])]
        if lower:
            piece = LOWER[piece]
        p, inv = power_tables(len(piece) + 1)
        h = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * p[:len(piece)], out=h[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((h[e] - h[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    for k in np.flatnonzero(ends - starts > LONG_SPAN):
        span = raw[starts[k]:ends[k]]
        out[k] = int.from_bytes(hashlib.blake2b((LOWER[span] if lower else span).tobytes(), digest_size=8).digest(), "little")
    return out


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` consecutive hashes (ordered)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        acc += h[j:j + n] * np.uint64(pow(_BASE, j + 1, 1 << 64))
    return mix(acc)


def sorted_distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    if len(a) < 2:
        return a
    keep = np.empty(len(a), dtype=bool)
    keep[0] = True
    np.not_equal(a[1:], a[:-1], out=keep[1:])
    return a[keep]
