"""Vectorised word and shingle hashing over Arrow text columns.

A column's bytes are hashed in place: with powers P of an odd base, the hash of bytes [a, b) is
(C[b] - C[a]) / P[a], where C are running sums modulo 2**64, so that all words of a segment take a few
array operations. Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + 1)
        _powers[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts and ends; null rows are empty."""
    if pa.types.is_dictionary(column.type) or not len(column):
        column = column.cast(pa.string()) if len(column) else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    n = len(column)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if buffers[1] is not None and n else np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def segments(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about SEGMENT bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of rows data[bounds[i]:bounds[i+1]], and for each row where its words start (one more at the end)."""
    if len(data) > 4 * SEGMENT and len(bounds) == 2:
        return _hash_long(data)
    starts, ends = word_spans(data, bounds)
    return _hash_spans(data, starts, ends), np.searchsorted(starts, bounds)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sep = SEPARATOR[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = sep[: n - 1]
    edge[bounds] = True
    starts = np.flatnonzero(edge[:n] & ~sep)
    edge[1:n] = sep[1:]
    edge[bounds] = True
    ends = np.flatnonzero(edge[1:] & ~sep) + 1
    return starts, ends


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, q = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=c[1:])
    return mix((c[ends] - c[starts]) * q[starts])


def _hash_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One very long row, in pieces that end at separators; a word over a piece's length is read whole."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n and not SEPARATOR[data[end]]:
            ahead = np.flatnonzero(SEPARATOR[data[end : end + SEGMENT]])
            end = end + int(ahead[0]) if len(ahead) else min(n, end + SEGMENT)
        piece = data[at:end]
        out.append(_hash_spans(piece, *word_spans(piece, np.array([0, len(piece)]))))
        at = end
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return hashes, np.array([0, len(hashes)])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; of fewer words, that of the whole sequence; of none, none."""
    n = len(words)
    if not n:
        return words
    size_here = min(size, n)
    h = np.full(n - size_here + 1, size_here * 0x632BE59BD9B4E019 & MASK, np.uint64)
    for j in range(size_here):
        h += words[j : n - size_here + 1 + j] * np.uint64((BASE * (2 * j + 3) | 1) & MASK)
    return mix(h)


def text_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) of each row of a text column."""
    data, offsets = column_bytes(column)
    for i, j in segments(offsets):
        lo = offsets[i]
        hashes, at = hash_words(data[lo : offsets[j]], offsets[i : j + 1] - lo)
        for k in range(j - i):
            yield i + k, hashes[at[k] : at[k + 1]]
