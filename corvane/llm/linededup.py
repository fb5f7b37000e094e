"""Fuzzy line deduplication.

Lines (split at \\n) of at least `min_chars` letters and digits take part; others always stay. Equal lines (after case
folding of A-Z and squeezing blanks) are one class. A class's signature is the MinHash of its distinct `k`-character
shingles; `bands` bands of `rows` coordinates each give high recall (at Jaccard 0.8 a pair is missed with chance
(1 - 0.8**rows) ** bands, 2e-4 by default). Pairs that share a bucket of a band are verified by the exact Jaccard
similarity of their shingle sets, in two passes:

  near   each class meets the bucket's first class and its neighbour in order; links are merged into components.
  rest   a bucket of four or more classes (in a smaller one, all have met) whose members are in one component is done. Of the
         others, all members of one of less than about `whole` classes are compared; those of larger ones are joined by prefixes of their sets, exactly: shingles are put in one order, rare ones
         first, and two sets of sizes n <= m of the wanted similarity t share one of the first n - ceil(2t/(1+t) n) + 1 of
         the smaller and m - ceil(t m) + 1 of the larger, at places that leave room for the whole overlap. What lines of
         one template share lies behind their prefixes in the main, so few of them meet; a family of near-equal lines among
         them mostly is one component already, by buckets of its own, and lines of one component don't meet.

A distributed union-find makes components, and of each component the first line (least document id, then text hash, then
line number) is kept, all others go.

A task sends a line's bands once, however often it holds the line, as packed records by range of key. Of a bucket that
has more than `local` lines in one task, all but the first and the last meet there and aren't sent on; a reader that
holds `held` records of a range lets them meet and goes on with one record a bucket. So a hot bucket is never in one place.

Defined cases: null and empty texts have no lines; lines too short to take part stay, however often they repeat; equal
rows (id and text alike) are one document: their lines are decided alike; rows of a null id sort first; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .graph import components, contract
from .shared import release_table, stage


@dataclass(frozen=True)
class Settings:
    k: int = 8
    bands: int = 16
    rows: int = 4
    percent: int = 80
    min_chars: int = 20
    block: int = 1024  # lines of a block, and bytes of their sets; a cell holds two blocks
    block_bytes: int = 8 << 20
    local: int = 32
    held: int = 1 << 23
    whole: int = 32  # lines of a mixed bucket from which on it is joined by prefixes


#: What counts towards min_chars: letters, digits and first bytes of other characters.
_COUNTS = np.array([0x30 <= b < 0x3A or 0x41 <= b < 0x5B or 0x61 <= b < 0x7B or b >= 0xC0 for b in range(256)], np.uint8).tobytes()
#: Lower case, and one kind of blank; line feeds stay.
_NORMAL = np.where(B.NOT_BLANK | (np.arange(256) == 10), B.LOWER, np.uint8(0x20)).tobytes()
_SOLID = B.NOT_BLANK.tobytes()
_CODE = B.mix(np.arange(1, (1 << 16) + 1, dtype=B.U64))
_CODE32 = (_CODE >> B.U64(32)).astype(np.uint32)
_SHINGLE = B.U64(0xD6E8FEB86659FD93)


#: Elements that are mixed at once, so that they stay in the cache.
_BLOCK = 1 << 15
_MIX = {np.uint32: ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)), B.U64: ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93), (32, 1))}


def _mixed_in_place(x: np.ndarray, word: type) -> np.ndarray:
    """A bijective finaliser on words (B.mix for 64 bits)."""
    spare = np.empty(min(len(x), _BLOCK), word)
    for lo in range(0, len(x), _BLOCK):
        some = x[lo : lo + _BLOCK]
        for shift, factor in _MIX[word]:
            some ^= np.right_shift(some, word(shift), out=spare[: len(some)])
            if factor != 1:
                some *= word(factor)
    return x


def line_shingles(data: bytes, k: int, word: type = B.U64) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets) of lines that each end with a line feed, repeats included; a line shorter than k is one shingle. word: 64-bit hashes, or 32-bit ones in half the time."""
    mix = lambda x: _mixed_in_place(x, word)
    codes, step = (_CODE, _SHINGLE) if word is B.U64 else (_CODE32, np.uint32(_SHINGLE & B.U64(0xFFFFFFFF)))
    code = np.frombuffer(data, np.uint8)
    if not data.isascii():
        code = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    end = np.flatnonzero(code == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    size = end - start
    n = np.maximum(size - k + 1, np.minimum(size, 1))
    total = np.concatenate([[0], np.cumsum(n)])
    h = codes.take(code, mode="clip")
    if code.dtype != np.uint8 and int(code.max()) >= 1 << 16:
        high = np.flatnonzero(code >= 1 << 16)
        h[high] = mix(code[high].astype(word) + word(1))
    h[end] = 0  # so what a short line's shingle takes from beyond its end is nothing
    out, have = h, 1
    whole = None
    done = 0
    for bit in range(k.bit_length()):  # polynomial hash of k codes, doubling
        if k >> bit & 1:
            if whole is None:
                whole = out if done + have == k else out.copy()
            else:
                whole = whole * step
                whole[: max(len(h) - done, 0)] += out[done:]
            done += have
        if done < k:
            twice = out * step
            twice[: max(len(h) - have, 0)] += out[have:]
            out, have, step = twice, 2 * have, word(int(step) ** 2 % (1 << 8 * h.itemsize))
    inside = np.ones(len(h), bool)  # where a shingle begins
    for back in range(k):
        inside[np.maximum(end - back, start)] = False
    short = np.flatnonzero((size < k) & (size > 0))
    inside[start[short]] = True
    found = whole[inside]
    for i in short.tolist():  # their shingle ends with the line
        x = np.zeros(1, word)
        for c in range(start[i], end[i]):
            x = mix(x + h[c : c + 1])
        found[total[i]] = x[0]
    return mix(found), total


def line_coordinates(low: np.ndarray, at: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """Coordinates of each non-empty line from 32-bit shingles, one after the other: the least values of half as many hash functions, then their greatest, which two sets share with the same chance."""
    x, greatest = np.empty_like(low), []
    for key in _coordinate_keys(s)[: (s.bands * s.rows + 1) // 2]:
        np.multiply(low, np.uint32((key >> B.U64(32)) | B.U64(1)), out=x)
        yield np.minimum.reduceat(x, at[:-1])
        greatest.append(np.maximum.reduceat(x, at[:-1]))
    yield from greatest[: s.bands * s.rows // 2]


def _coordinate_keys(s: Settings) -> np.ndarray:
    return B.mix(np.arange(1, s.bands * s.rows + 1, dtype=B.U64) * B.U64(0x9E3779B97F4A7C15))


def line_bands(coordinates: Iterator[np.ndarray], s: Settings) -> np.ndarray:
    """A row of band keys for each line, from its coordinates."""
    keys, out, acc = _coordinate_keys(s), [], None
    for c, least in enumerate(coordinates):
        acc = np.full(len(least), keys[c], B.U64) if c % s.rows == 0 else acc
        acc = B.mix(acc ^ least.astype(B.U64)) + acc
        if c % s.rows == s.rows - 1:
            out.append(B.mix(acc))
    return np.stack(out, 1).view(np.int64)


def _ids(data: bytes) -> np.ndarray:
    """Two 64-bit words of the digest of each line; lines end with a line feed."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in data.split(b"\n")[:-1]]), np.int64).reshape(-1, 2)


def taking_part(text: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(text, line number, normal forms that each end with a line feed) of the lines that take part."""
    buf, offs = B.raw(pc.binary_join_element_wise(text, "", "\n"))
    feed = buf == 10
    end = np.flatnonzero(feed)
    begin = np.concatenate([[0], end[:-1] + 1])
    if not len(end):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), b""
    data = buf.tobytes()
    takes = np.add.reduceat(np.frombuffer(data.translate(_COUNTS), np.uint8), begin, dtype=np.int32) >= s.min_chars
    first = np.searchsorted(begin, offs[:-1])
    doc = np.searchsorted(first, np.flatnonzero(takes), "right") - 1
    inside = np.repeat(takes, end - begin + 1)
    solid = np.frombuffer(data.translate(_SOLID), bool) & inside
    opens = solid.copy()  # words begin; \n is a blank
    opens[1:] &= ~solid[:-1]
    at = np.flatnonzero(opens)
    opens[at[np.searchsorted(at, begin[takes])]] = False  # the first of a line has no blank before it
    keep = solid | (feed & inside)
    keep[:-1] |= opens[1:]
    return doc, np.flatnonzero(takes) - first[doc], buf[keep].tobytes().translate(_NORMAL)


def _keyed(fresh: np.ndarray, keys: np.ndarray) -> pa.Array:
    """The rows of keys as bytes where fresh, null elsewhere."""
    at = np.concatenate([[0], np.cumsum(fresh)]).astype(np.int32) * np.int32(keys.shape[1] * keys.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(fresh), [pa.py_buffer(np.packbits(fresh, bitorder="little")), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(keys))])


def _lines(s: Settings):
    """Rows (_id, _t, _pos, _l1, _l2, _keys) of lines that take part; band keys once for a line of a task, mostly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            text = B.text_array(batch.column(2))
            for lo, hi in B.slices(text, 1 << 19):
                doc, pos, data = taking_part(text.slice(lo, hi - lo), s)
                if not len(doc):
                    continue
                ids, take = _ids(data), pa.array(doc + lo)
                fresh = np.zeros(len(ids), bool)
                fresh[np.unique(ids[:, 0], return_index=True)[1]] = True
                fresh &= np.array([i not in seen for i in ids[:, 0].tolist()])
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.update(ids[fresh, 0].tolist())
                parts = [list(line_coordinates(*line_shingles(some, s.k, np.uint32), s)) for some in _pieces(_some(data, fresh))]
                keys = line_bands(map(np.concatenate, zip(*parts, strict=True)), s) if parts else np.zeros((0, s.bands), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(ids[:, 0]), pa.array(ids[:, 1]), _keyed(fresh, keys)], ["_id", "_t", "_pos", "_l1", "_l2", "_keys"])

    return run


def _some(data: bytes, which: np.ndarray) -> bytes:
    """The lines of a mask."""
    if which.all():
        return data
    buf = np.frombuffer(data, np.uint8)
    size = np.diff(np.concatenate([[-1], np.flatnonzero(buf == 10)]))
    return buf[np.repeat(which, size)].tobytes()


def _pieces(data: bytes, limit: int = 1 << 17) -> Iterator[bytes]:
    """Whole lines of about `limit` bytes; a longer line is a piece of its own."""
    lo = 0
    while lo < len(data):
        hi = data.find(b"\n", min(lo + limit, len(data)) - 1) + 1
        yield data[lo:hi]
        lo = hi


_MET = ["_key", "_l1", "_first", "_last"]


class _Buckets:
    """Lets the lines of a bucket meet: each but the first meets the first and the one before it."""

    def __init__(self):
        self.key, self.first, self.last = (np.zeros(0, np.int64) for _ in range(3))

    def met(self, key: np.ndarray, line: np.ndarray, hold: bool, at_least: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(rows of _MET of buckets of at_least lines, mask of records that were in none). hold: remember a record for each bucket, for later calls."""
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        begin = np.flatnonzero(np.concatenate([[True], ~same])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(k)))
        multi = np.repeat(size >= at_least, size)
        if len(self.key):
            known = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            multi |= self.key[known] == k
        some = order[multi]
        some = some[np.lexsort((line[some], key[some]))]
        x, y = key[some], line[some]
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        fresh = new.copy()
        fresh[1:] |= y[1:] != y[:-1]
        some, x, y, new = some[fresh], x[fresh], y[fresh], new[fresh]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(x)))
        first, last = np.repeat(y[begin], size), np.concatenate([y[:1], y[:-1]])
        meets = ~new & (np.repeat(size, size) >= at_least)
        if len(self.key) and len(x):
            known = np.minimum(np.searchsorted(self.key, x[begin]), len(self.key) - 1)
            old = self.key[known] == x[begin]
            every = np.repeat(old, size)
            first = np.where(every, np.repeat(self.first[known], size), first)
            last[begin[old]] = self.last[known[old]]
            meets = every | meets
            meets &= (y != first)
        rows = np.stack([x, y, first, last])[:, meets]
        alone = np.ones(len(line), bool)
        alone[some[np.repeat(size, size) >= at_least]] = False
        if hold and len(k):
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            now = line[order]
            key = np.concatenate([self.key, k[begin]])
            self.key, at, of = np.unique(key, return_index=True, return_inverse=True)  # what is held already comes first
            self.first = np.concatenate([self.first, now[begin]])[at]
            last = np.empty(len(self.key), np.int64)
            last[of] = np.concatenate([self.last, now[np.append(begin[1:], len(k)) - 1]])  # the later one stays
            self.last = last
        return rows, alone


def _records(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows.T).tobytes()


def _banded(s: Settings, parts: int):
    """Rows (_part, _kind, _data) from rows (_l1, _keys): packed records of a range of keys. Kind 0: (_key, _l1); kind 1: _MET of buckets that have more than s.local lines here."""

    def flush(keys: list[np.ndarray], lines: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, line = np.concatenate(keys), np.concatenate(lines)
        order = np.argsort(key.view(B.U64))
        key, line = key[order], line[order]
        met = np.zeros((4, 0), np.int64)
        if (key[s.local :] == key[: max(len(key) - s.local, 0)]).any():
            met, alone = _Buckets().met(key, line, False, s.local + 1)
        if met.shape[1]:  # of such a bucket, its first and its last line go on
            new = np.ones(met.shape[1] + 1, bool)
            new[1:-1] = met[0, 1:] != met[0, :-1]
            ends = [met[[0, 2]][:, new[:-1]], met[:2][:, new[1:]]]
            key, line = (np.concatenate([x[alone], *(e[i] for e in ends)]) for i, x in enumerate((key, line)))
        out = [(0, np.stack([key, line]))] + ([(1, met)] if met.shape[1] else [])
        for kind, rows in out:
            part = ((rows[0].view(B.U64) >> B.U64(32)) * B.U64(parts) >> B.U64(32)).astype(np.int64)
            if (part[1:] < part[:-1]).any():
                order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")  # by radix, if parts are few
                part, rows = part[order], rows[:, order]
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            pairs = list(zip(cuts, cuts[1:], strict=False))
            for at in range(0, len(pairs), 64):  # a bounded batch each
                some = pairs[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in some], pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array([_records(rows[:, a:b]) for a, b in some], pa.binary())], ["_part", "_kind", "_data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines, held = [], [], 0
        for batch in batches:
            for x in (batch.slice(lo, 8192) for lo in range(0, batch.num_rows, 8192)):
                lines.append(np.repeat(x.column(0).to_numpy(), s.bands))
                keys.append(B.raw(x.column(1))[0].view(np.int64))
                held += len(keys[-1])
                if held >= 1 << 20:
                    yield from flush(keys, lines)
                    keys, lines, held = [], [], 0
        if held:
            yield from flush(keys, lines)

    return run


def _meet(s: Settings):
    """Rows of _MET and _many, from rows (_part, _kind, _data) sorted by _part. _many is false if the bucket has less than four lines."""

    def table(rows: np.ndarray, many: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        many = np.ones(rows.shape[1], bool) if many is None else many
        for lo in range(0, rows.shape[1], 1 << 17):
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows[:, lo : lo + (1 << 17)]), pa.array(many[lo : lo + (1 << 17)])], [*_MET, "_many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, last, blobs, held, hot = _Buckets(), None, [], 0, []

        def ended() -> Iterator[pa.RecordBatch]:
            whole = not len(buckets.key)  # all records of the range, but those of kind 1
            rows = flush(False)
            if not whole or not rows.shape[1]:
                yield from table(rows)
                return
            begin = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            size = np.diff(np.append(begin, rows.shape[1]))
            many = np.repeat(size > 2, size)
            yield from table(rows, many | np.isin(rows[0], np.concatenate(hot)) if hot else many)

        def flush(hold: bool) -> np.ndarray:
            pairs = np.concatenate(blobs) if blobs else np.zeros((0, 2), np.int64)
            return buckets.met(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), hold)[0]

        for batch in batches:
            for part, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = np.frombuffer(data.as_buffer().to_pybytes(), np.int64).reshape(-1, 4 if kind else 2)
                if part != last:
                    yield from ended()
                    buckets, last, blobs, held, hot = _Buckets(), part, [], 0, []
                if kind:
                    hot.append(np.unique(rows[:, 0]))
                    yield from table(rows.T)
                    continue
                blobs.append(rows)
                held += len(rows)
                if held >= max(s.held, 2 * len(buckets.key)):
                    yield from table(flush(True))
                    blobs, held = [], 0
        yield from ended()

    return run


def _fed(lines: list[bytes]) -> bytes:
    return b"\n".join(lines) + b"\n"


def _wanted_lines(s: Settings):
    """Rows (_l1, _l2, _line) of each distinct line of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, text = batch.column(0).to_pylist(), B.text_array(batch.column(1))
            ids, out, seen = [], [], set()
            for pos, t in zip(at, text, strict=True):
                lines = t.as_buffer().to_pybytes().split(b"\n")
                for p in pos:
                    x = b" ".join(lines[p].lower().split())
                    if x not in seen:
                        seen.add(x)
                        out.append(x)
            if out:
                ids = _ids(_fed(out))
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(out, pa.binary())], ["_l1", "_l2", "_line"])

    return run


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each lo on, one range after the other."""
    end = np.cumsum(n)
    return np.arange(int(end[-1]) if len(n) else 0) + np.repeat(lo - (end - n), n)


def _numbered(values: list) -> tuple[np.ndarray, list]:
    """(number of each value among the distinct ones, these)."""
    number = {v: k for k, v in enumerate(dict.fromkeys(values))}
    return np.array([number[v] for v in values], np.int64), list(number)


def line_sets(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each line, ascending; offsets)."""
    shingle, at = line_shingles(data, k)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):  # lines are small, so each is sorted in the cache
        shingle[lo:hi].sort()
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    return shingle[new], np.concatenate([[0], np.cumsum(new)])[at]


def common(shingle: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of shingles that the lines x[i] and y[i] share."""
    out = np.empty(len(x), np.int64)
    bounds = zip(at[x].tolist(), at[x + 1].tolist(), at[y].tolist(), at[y + 1].tolist(), strict=True)
    for i, (a, b, c, d) in enumerate(bounds):
        both = np.concatenate((shingle[a:b], shingle[c:d]))
        both.sort()
        out[i] = np.count_nonzero(both[1:] == both[:-1])
    return out


def similar(shingle: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which of the lines x[i] and y[i] are as similar as wanted; sets of sizes too far apart aren't compared."""
    size = np.diff(at)
    out = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
    x, y = x[out], y[out]
    both = common(shingle, at, x, y)
    out[out] = 100 * both >= percent * (size[x] + size[y] - both)
    return out


def _verify(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_ = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3)))
            ok, lo = [], 0
            while lo < batch.num_rows:
                hi = min(max(int(np.searchsorted(bytes_, (bytes_[lo - 1] if lo else 0) + (1 << 21))), lo + 1), lo + 16384)
                x, y = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (2, 3))
                of, lines = _numbered([*x, *y])
                shingle, at = line_sets(_fed(lines), s.k)
                one, two = of[: len(x)], of[len(x) :]
                ok.append(similar(shingle, at, one, two, s.percent))
                lo = hi
            if ok:
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(np.concatenate(ok)))

    return run


#: Places of the table by which equal shingles of a bucket find each other.
_PLACES = 16


def columns(shingle: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A number for each shingle, the same for equal ones only, below twice their count. table: 2**_PLACES numbers, to be written over."""
    place = (shingle >> B.U64(64 - _PLACES)).astype(np.int64)
    table[place] = np.arange(len(shingle))
    out = table[place]
    other = np.flatnonzero(shingle[out] != shingle)  # those that share a place with another shingle
    if len(other):
        out[other] = len(shingle) + np.unique(shingle[other], return_inverse=True)[1]
    return out


def _met_whole(s: Settings):
    """Links (a, b) of all lines of a bucket that are in several components, from rows (_key, _no, _root, _line) sorted by _key."""
    table = np.zeros(1 << _PLACES, np.int64)

    def links(rows: pa.Table) -> pa.RecordBatch:
        key, no, root = (rows.column(c).to_numpy() for c in range(3))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ids, at, of = np.unique(no, return_index=True, return_inverse=True)
        shingles, offsets = line_sets(_fed(rows.column(3).take(pa.array(at)).to_pylist()), s.k)
        size, a, b, single = np.diff(offsets), [], [], []
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True):
            line, n = of[lo:hi], hi - lo
            x, y = np.nonzero(root[lo:hi][:, None] > root[lo:hi])
            total = int(size[line].sum())
            if len(x) * (400 + 2 * total // n) < 10_000 + 5 * total:  # about what either way takes
                single.append(line[x] * len(ids) + line[y])
                continue
            column = columns(shingles[_ranges(offsets[line], size[line])], table)
            shared = np.bincount(column) > 1
            held = np.zeros((n, int(np.count_nonzero(shared))), np.float32)
            some = shared[column]
            held[np.repeat(np.arange(n), size[line])[some], (np.cumsum(shared) - 1)[column[some]]] = 1
            both, x, y = (held @ held.T)[x, y].astype(np.int64), line[x], line[y]
            ok = 100 * both >= s.percent * (size[x] + size[y] - both)
            a.append(x[ok])
            b.append(y[ok])
        if single:
            x, y = np.divmod(np.unique(np.concatenate(single)), len(ids))  # lines that meet in several buckets meet once
            ok = similar(shingles, offsets, x, y, s.percent)
            a.append(x[ok])
            b.append(y[ok])
        return pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(z)]) for z in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in (b.slice(lo, 4096) for b in batches for lo in range(0, b.num_rows, 4096)):
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= 16384 or size >= 2 << 20:
                rows = pa.Table.from_batches(held)
                key = rows.column(0).to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if whole:
                    yield links(rows.slice(0, whole))
                    rows = rows.slice(whole)
                    held, n, size = rows.to_batches(), rows.num_rows, rows.nbytes
        if n:
            yield links(pa.Table.from_batches(held))

    return run


#: Shingles are ordered by how often their slot (upper bits) is met among the lines to join, so the table of counts is bounded.
SLOT_BITS = 22


def _sets(s: Settings):
    """Rows (_l1, _root, _set): the distinct shingles of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, upto = batch.column(2), np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            lo = 0
            while lo < batch.num_rows:
                hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 19), "right")), lo + 1)
                shingle, at = line_sets(_fed(line.slice(lo, hi - lo).to_pylist()), s.k)
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(shingle.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in (0, 1)), sets], ["_l1", "_root", "_set"])
                lo = hi

    return run


def _least(n: np.ndarray, above: int, below: int) -> np.ndarray:
    """n * above / below, rounded up."""
    return -(-n * above // below)


def _prefixes(s: Settings, counts: np.ndarray):
    """Rows (_h, _l1, _root, _n, _at, _held) of a line's prefix: shingle, component, set size, place; is it in the shorter prefix, that of the smaller set? Shingles of one line alone are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            shingle = batch.column(2).flatten().to_numpy().view(B.U64)
            of, met = np.repeat(np.arange(len(n)), n), counts[shingle >> B.U64(64 - SLOT_BITS)]
            order = np.lexsort((shingle, met, of))
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            long, short = n - _least(n, s.percent, 100) + 1, n - _least(n, 2 * s.percent, 100 + s.percent) + 1
            keep = np.flatnonzero((at < long[of]) & (met[order] > 1))
            of, at = of[keep], at[keep]
            cols = [pa.array(shingle[order][keep].view(np.int64)), *(batch.column(c).take(pa.array(of)) for c in (0, 1)), pa.array(n[of]), pa.array(at), pa.array(at < short[of])]
            for lo in range(0, len(keep), 1 << 17):
                yield pa.RecordBatch.from_arrays([c.slice(lo, 1 << 17) for c in cols], ["_h", "_l1", "_root", "_n", "_at", "_held"])

    return run


class Cell:
    """The sets of some lines, for counting what many pairs of them share."""

    def __init__(self, ids: np.ndarray, lines: list[bytes], k: int):
        order = np.argsort(ids)
        self.ids = ids[order]
        self.shingle, self.at = line_sets(_fed([lines[i] for i in order]), k)
        self.size = np.diff(self.at)
        self.line = np.repeat(np.arange(len(ids), dtype=np.int32), self.size)
        self.table: np.ndarray | None = None

    def _every(self) -> np.ndarray:
        """Shared shingles of each two lines: rare shingles pair by pair, others as products of columns."""
        n = len(self.ids)
        table, order = np.zeros((n, n), np.float32), np.argsort(self.shingle, kind="stable")
        line, h = self.line[order], self.shingle[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        met = np.diff(np.append(begin, len(h)))
        pairs = []
        for m in range(2, 9):
            of = line[_ranges(begin[met == m], met[met == m])].reshape(-1, m).astype(np.int64)
            pairs += [of[:, i] * n + of[:, j] for i in range(m) for j in range(m) if i != j and len(of)]
        if pairs:
            table += np.bincount(np.concatenate(pairs), minlength=n * n).reshape(n, n)
        begin, met = begin[met > 8], met[met > 8]
        for lo in range(0, len(begin), 2048):
            some = met[lo : lo + 2048]
            column = np.zeros((n, len(some)), np.float32)
            column[line[_ranges(begin[lo : lo + 2048], some)], np.repeat(np.arange(len(some)), some)] = 1
            table += column @ column.T
        return table

    def linked(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs of ids are as similar as wanted."""
        x, y = np.searchsorted(self.ids, x), np.searchsorted(self.ids, y)
        n, m = self.size[x], self.size[y]
        if self.table is None and len(x) > len(self.ids) ** 2 // 500 + 2 * len(self.ids):  # else pair by pair is less work
            self.table = self._every()
        if self.table is not None:
            both = self.table[x, y].astype(np.int64)
        else:
            both, upto, lo = np.zeros(len(x), np.int64), np.cumsum(n + m), 0
            while lo < len(x):
                hi = min(max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 20))), lo + 1), len(x))
                h = np.concatenate([self.shingle[_ranges(self.at[z[lo:hi]], self.size[z[lo:hi]])] for z in (x, y)])
                pair = np.concatenate([np.repeat(np.arange(hi - lo), self.size[z[lo:hi]]) for z in (x, y)])
                order = np.lexsort((h, pair))
                h, pair = h[order], pair[order]
                same = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
                both[lo:hi] = np.bincount(pair[1:][same], minlength=hi - lo)
                lo = hi
        return 100 * both >= percent * (n + m - both)


def _linked(s: Settings):
    """Links (a, b) of cells: rows (_i, _j, _pair, a, b, _line), sorted; a cell's lines come before its pairs."""

    def links(cell: Cell, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        ok = cell.linked(x, y, s.percent)
        root = contract(np.searchsorted(cell.ids, x[ok]), np.searchsorted(cell.ids, y[ok]), len(cell.ids))
        child = np.flatnonzero(root != np.arange(len(root)))  # as many links as lines at most
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(cell.ids[child]), pa.array(cell.ids[root[child]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, lines, cell, held, n = None, [], [], None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal cell, held, n
            if held:
                cell = cell or Cell(np.array(ids, np.int64), lines, s.k)
                yield from links(cell, *(np.concatenate([h[k] for h in held]) for k in (0, 1)))
                held, n = [], 0

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if tuple(key[lo, :2]) != last:
                    yield from flush()
                    last, ids, lines, cell = tuple(key[lo, :2]), [], [], None
                if key[lo, 2]:
                    held.append([batch.column(c).slice(lo, hi - lo).to_numpy() for c in (3, 4)])
                    n += hi - lo
                    if n >= 1 << 20:
                        yield from flush()
                else:
                    ids += batch.column(3).slice(lo, hi - lo).to_pylist()
                    lines += batch.column(5).slice(lo, hi - lo).to_pylist()
        yield from flush()

    return run


def _verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) by number, of the pairs (a, b) of lines by _l1 that are as similar as wanted."""
    texts = texts.select("_l1", "_no", "_line")
    both = pairs.join(texts.toDF("a", "_a", "_x").hint("shuffle_hash"), "a").join(texts.toDF("b", "_b", "_y").hint("shuffle_hash"), "b").select("_a", "_b", "_x", "_y")
    return stage(both.mapInArrow(_verify(s), "a long, b long"), "links")


def _verified_in_cells(pairs: DataFrame, texts: DataFrame, blocks: int, s: Settings) -> DataFrame:
    """Of pairs (a, b) by number, links enough for the same components, where lines have many pairs: a line goes once to each cell of two blocks that needs it, not with each pair."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    i, j = block("a"), block("b")
    dealt = stage(pairs.distinct().select(F.least(i, j).alias("_i"), F.greatest(i, j).alias("_j"), "a", "b"), "pairs")
    need = dealt.select("_i", "_j", F.col("a").alias("_no")).unionByName(dealt.select("_i", "_j", F.col("b").alias("_no"))).distinct()
    rows = need.join(texts.select("_no", "_line"), "_no").select("_i", "_j", F.lit(False).alias("_pair"), F.col("_no").alias("a"), F.lit(None).cast("long").alias("b"), "_line")
    rows = rows.unionByName(dealt.select("_i", "_j", F.lit(True).alias("_pair"), "a", "b", F.lit(None).cast("binary").alias("_line")))
    out = stage(rows.repartition("_i", "_j").sortWithinPartitions("_i", "_j", "_pair").mapInArrow(_linked(s), "a long, b long"), "links")
    release_table(dealt)
    return out


def _rooted(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """lines with _root, by their _no."""
    return lines.join(roots.select(F.col("node").alias("_no"), F.col("root").alias("_root")).hint("shuffle_hash"), "_no", "left").withColumn("_root", F.coalesce("_root", "_no"))


def _mixed(entries: DataFrame) -> DataFrame:
    """The entries of lists that lie in several components."""
    lists = entries.groupBy("_h").agg(F.min("_root").alias("_r0"), F.max("_root").alias("_r1"), F.max("_held").alias("_p")).filter("_r0 <> _r1 and _p").select("_h")
    lists = stage(lists, "mixed-lists")
    mixed = stage(entries.join(lists, "_h"), "mixed-prefixes")
    release_table(lists)
    return mixed


def link_rest(met: DataFrame, texts: DataFrame, roots: DataFrame, s: Settings) -> DataFrame:
    """(node, root) of the components, with all links in buckets of four or more that hold several of the components so far. met: rows of _meet, those of smaller buckets aren't moved; roots: (node, root) so far."""
    met = met.filter("_many")
    rooted = _rooted(texts.select("_l1", "_no"), roots)  # texts are only joined to what is left of the lines
    every = met.select("_key", "_l1", F.lit(1).alias("_more")).unionByName(met.select("_key", F.col("_first").alias("_l1"), F.lit(0).alias("_more")))
    member = stage(every.join(rooted.select("_l1", "_no", "_root").hint("shuffle_hash"), "_l1").select("_key", "_no", "_root", "_more"), "members")
    mixed = stage(member.groupBy("_key").agg(F.min("_root").alias("_r0"), F.max("_root").alias("_r1"), F.sum("_more").alias("_n")).filter("_r0 <> _r1 and _n > 2").select("_key", "_n"), "mixed-buckets")
    of = lambda few: member.join(mixed.filter(F.col("_n") < s.whole if few else F.col("_n") >= s.whole).select("_key").hint("shuffle_hash"), "_key")
    lines = texts.select("_no", "_line").hint("shuffle_hash")
    met_whole = of(True).select("_key", "_no", "_root").distinct().join(lines, "_no").select("_key", "_no", "_root", "_line")
    links = stage(met_whole.repartition("_key").sortWithinPartitions("_key").mapInArrow(_met_whole(s), "a long, b long"), "links")
    many = stage(of(False).select("_no", "_root").distinct(), "mixed-lines")
    for table in (member, mixed):
        release_table(table)
    more = None if many.isEmpty() else _joined_by_prefixes(stage(many.join(lines, "_no").select("_no", "_root", "_line"), "mixed-texts"), s)
    found = links if more is None else links.unionByName(more)
    out = roots if found.isEmpty() else components(roots.toDF("a", "b").unionByName(found))
    for table in (many, found):
        release_table(table)
    return out


def _joined_by_prefixes(mine: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b), enough for the components, of rows (_no, _root, _line) of different components; mine is deleted."""
    spark = mine.sparkSession
    sets = stage(mine.mapInArrow(_sets(s), "_l1 long, _root long, _set array<long>"), "sets")
    n_lines, shingles = sets.agg(F.count("*"), F.sum(F.size("_set").cast("long"))).first()
    blocks = max(1, -(-n_lines // s.block), -(-8 * shingles // s.block_bytes))
    slots = sets.select(F.explode(F.transform("_set", lambda h: F.shiftrightunsigned(h, 64 - SLOT_BITS))).alias("_slot")).groupBy("_slot").count().filter("count > 1").toArrow()  # 2**SLOT_BITS rows at most
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[slots["_slot"].to_numpy()] = slots["count"].to_numpy()
    held = spark.sparkContext.broadcast(counts)
    every = sets.mapInArrow(lambda batches: _prefixes(s, held.value)(batches), "_h long, _l1 long, _root long, _n long, _at long, _held boolean")
    prefixes = stage(every, "prefixes")
    entries = _mixed(prefixes)
    for table in (sets, prefixes):  # not read again, and large
        release_table(table)

    pair = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    small = entries.filter("_held").select("_h", F.col("_l1").alias("b"), F.col("_n").alias("m"), F.col("_at").alias("_bt"), F.col("_root").alias("_other"))
    earlier = (F.col("m") < F.col("_n")) | (F.col("m") == F.col("_n")) & (F.col("b") < F.col("_l1"))
    room = F.least(F.col("_n") - F.col("_at"), F.col("m") - F.col("_bt"))  # what they can share from here on
    near = earlier & (F.col("_root") != F.col("_other")) & (100 * F.col("m") >= s.percent * F.col("_n")) & ((100 + s.percent) * room >= s.percent * (F.col("_n") + F.col("m")))
    links = _verified_in_cells(entries.join(small, "_h").filter(near).select(*pair("_l1", "b")), mine, blocks, s)
    for table in (entries, mine):
        release_table(table)
    return links


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to ascending line numbers a flag for each line up to the last, so that a lookup takes constant time."""
    for batch in batches:
        flags = []
        for numbers in batch.column(2):
            x = np.zeros(numbers[-1].as_py() + 1, bool)
            x[numbers.values.to_numpy()] = True
            flags.append(x)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.list_(pa.bool_()))], ["_id", "_t", "removed", "flags"])


def removed_lines(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _t, removed array<int>, flags array<boolean>): numbers of the lines that go, and the same by line number, for each document (id, xxhash64 of text) that loses any."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), text.alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    lines = stage(rows.mapInArrow(_lines(s), f"_id {kind}, _t long, _pos int, _l1 long, _l2 long, _keys binary"), "lines", "lz4_raw")  # keys don't get smaller
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = lines.filter("_keys is not null")
    bands = once.select("_l1", "_keys").mapInArrow(_banded(s, parts), "_part int, _kind int, _data binary").repartition("_part").sortWithinPartitions("_part")
    met = stage(bands.mapInArrow(_meet(s), "_key long, _l1 long, _first long, _last long, _many boolean"), "buckets")
    pair = lambda rows, c: rows.select(F.greatest("_l1", c).alias("a"), F.least("_l1", c).alias("b"))
    cand = stage(pair(met, "_first").unionByName(pair(met.filter("_last <> _first"), "_last")).distinct(), "candidates")
    wanted = cand.select(F.col("a").alias("_l1")).unionByName(cand.select(F.col("b").alias("_l1"))).distinct()
    places = once.select("_id", "_t", "_pos", "_l1", "_l2").join(wanted.hint("shuffle_hash"), "_l1").groupBy("_l1", "_l2").agg(F.min(F.struct("_id", "_t", "_pos")).alias("_at"))
    where = places.select("_at.*").groupBy("_id", "_t").agg(F.collect_set("_pos").alias("_at"))  # within one document
    where = where.select(F.col("_id").alias("_wid"), F.col("_t").alias("_wt"), "_at")
    found = rows.join(where.hint("shuffle_hash"), rows["_id"].eqNullSafe(where["_wid"]) & (rows["_t"] == where["_wt"])).select("_at", "_text")
    texts = found.mapInArrow(_wanted_lines(s), "_l1 long, _l2 long, _line binary").dropDuplicates(["_l1", "_l2"])
    texts = stage(texts.withColumn("_no", F.monotonically_increasing_id()), "texts")  # lines are nodes by these numbers
    near = _verified(cand, texts, s)
    roots = components(near)
    for table in (cand, near):  # here and below: tables that nothing reads any more
        release_table(table)
    first, roots = roots, link_rest(met, texts, roots, s)
    release_table(met)
    # Lines that repeat, and those of a component by its least number's line; the rest of the lines lose nothing.
    name = lambda no, *names: texts.select("_no", "_l1", "_l2").toDF(no, *names)
    linked = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(name("node", "_l1", "_l2"), "node").join(name("root", "_r1", "_r2"), "root")
    none = F.lit(None).cast("long")
    every = lines.select("_l1", "_l2", F.lit(1).alias("_n"), none.alias("_r1"), none.alias("_r2")).unionByName(linked.select("_l1", "_l2", F.lit(0).alias("_n"), "_r1", "_r2"))
    groups = every.groupBy("_l1", "_l2").agg(F.sum("_n").alias("_n"), F.max("_r1").alias("_r1"), F.max("_r2").alias("_r2")).filter("_n > 1 or _r1 is not null")
    groups = stage(groups.select("_l1", "_l2", F.coalesce("_r1", "_l1").alias("_r1"), F.coalesce("_r2", "_l2").alias("_r2")), "groups")
    for table in (texts, first, roots):
        release_table(table)
    mine = stage(lines.drop("_keys").join(groups.hint("shuffle_hash"), ["_l1", "_l2"]).select("_id", "_t", "_pos", "_r1", "_r2"), "grouped")
    for table in (lines, groups):
        release_table(table)
    keep = stage(mine.groupBy("_r1", "_r2").agg(F.min(F.struct("_id", "_t", "_pos")).alias("_keep")), "keep")
    gone = mine.join(keep.hint("shuffle_hash"), ["_r1", "_r2"]).filter(~F.struct("_id", "_t", "_pos").eqNullSafe(F.col("_keep")))
    numbers = gone.groupBy("_id", "_t").agg(F.array_sort(F.collect_set("_pos")).alias("removed"))
    removed = stage(numbers.mapInArrow(_flagged, f"_id {kind}, _t long, removed array<int>, flags array<boolean>"), "removed")
    for table in (mine, keep):
        release_table(table)
    return removed


def dedup_lines(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `_removed` (array<int>, ascending line numbers) and `_kept_text` added; all their other columns stay."""
    docs = docs.drop("_removed", "_kept_text")
    gone = removed_lines(docs, s, id_col, text_col).select(F.col("_id").alias("_gid"), F.col("_t").alias("_gt"), F.col("removed").alias("_gone"), F.col("flags").alias("_gflags"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(gone.hint("shuffle_hash"), docs[id_col].eqNullSafe(gone["_gid"]) & (F.xxhash64(text) == gone["_gt"]), "left")
    left = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda x, i: ~F.coalesce(F.get(gone["_gflags"], i), F.lit(False))), "\n")
    return joined.select(*[docs[c] for c in docs.columns], F.coalesce(gone["_gone"], F.expr("cast(array() as array<int>)")).alias("_removed"), F.when(gone["_gone"].isNull(), docs[text_col]).otherwise(left).alias("_kept_text"))
