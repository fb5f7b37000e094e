"""Vectorised scanning of Arrow text batches: words, hashes, shingles and window minima as numpy arrays.

A batch of texts is one byte buffer with document offsets. Words are maximal runs of "word bytes"; a word never
crosses a document boundary. Hashes are 64 bits wide; wherever a result must be exact, callers compare the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_GRAM = U64(0xD6E8FEB86659FD93)
_powers = np.ones(1, U64)

#: Bytes that are not blanks: words `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all non-ASCII bytes: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers), 256), _BASE, U64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=U64)
    return _powers


def text_array(column) -> pa.Array:
    """A contiguous Arrow string array without nulls (null reads as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    return column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array from text_array; offsets start at 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer text makes a range of its own."""
    _, offs = raw(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, isword: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and one past the last document's)."""
    m = isword[buf]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1]
    end[:-1] &= ~m[1:]
    cut = offs[(offs > 0) & (offs < len(m))]
    start[cut] = m[cut]
    end[cut - 1] = m[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (non-empty, disjoint, ascending) span of bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    at = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=at[1:])
    pos = np.arange(int(size.sum()), dtype=np.int64)
    pos -= np.repeat(at, size)
    val = _BYTE[buf[pos + np.repeat(starts, size)]]
    val *= powers(int(size.max()))[pos]
    return mix(np.add.reduceat(val, at) + size.astype(U64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k-1 positions are left out."""
    if len(h) < k:
        return np.zeros(0, U64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= _GRAM
        out += h[j : len(h) - k + 1 + j]
    return mix(out)


def in_document(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether the k words from each of the n positions on lie in one document."""
    size = np.diff(first)
    left = np.repeat(first[1:], size) - np.arange(int(first[-1]))
    return left[:n] >= k


def window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = a, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(gram: np.ndarray, w: int) -> np.ndarray:
    """Position, for each window of w consecutive k-grams, of its minimum (leftmost of equals).

    Order is by the upper 36 bits, so it depends on content only; the lower 28 hold the position.
    """
    if len(gram) < w:
        return np.zeros(0, np.int64)
    if len(gram) >= 1 << 28:
        raise ValueError("a slice holds 2**28 words or more")
    low = U64((1 << 28) - 1)
    packed = (gram & ~low) | np.arange(len(gram), dtype=U64)
    return (window_min(packed, w) & low).astype(np.int64)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of positions 0..n-1 inside any [start, end)."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(d[:n]) > 0


def stretches(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of a mask; none goes over a document's border."""
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    cut = first[(first > 0) & (first < len(mask))]
    opens[cut] = mask[cut]
    closes[cut - 1] = mask[cut - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1
