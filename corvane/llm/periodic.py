"""Periodic runs: stretches of words that repeat with a period.

A run is a stretch of smallest period q that no neighbouring word extends, of at least max(min_length, exponent * q)
words. Of each run its first q words stay, the others are dropped.

A run shares max(min_length, exponent * q) - q words or more with itself moved by q, and the least such overlap over all
periods is k: each word of a run lies in a k-gram that occurs in the document again. So a document is masked first: words
outside its repeated k-grams can't join runs, and what is left falls into segments; each is masked again by the k-grams
that repeat within itself. Only segments that survive go through Main-Lorentz: halves are searched in turn, and runs over
the middle are read off the longest extensions to both sides (two Z arrays each), so a segment of n words takes n log n.

Words are compared by 64-bit hashes, within one document. Texts are scanned in slices of bounded size; a longer text is a
slice of its own. Nothing is shuffled.

Defined cases: null and empty texts have no words and no runs; equal rows are each answered; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

MIN_LENGTH, EXPONENT = 6, 4


def least_overlap(min_length: int, exponent: int) -> int:
    """Words that any run shares with itself moved by its period; beyond min_length it only grows."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))


def z_array(s: list[int]) -> list[int]:
    """How many elements from each place on equal those from the start on; 0 for the start itself."""
    n, left, right = len(s), 0, 0
    out = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def main_lorentz(s: list[int], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, end, period) of each run of s."""
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(s))]

    def run(begin: int, end: int, p: int) -> None:
        # What the node cuts off goes over the middle of a larger node and is found whole there.
        if end - begin >= max(min_length, exponent * p) and (begin > lo or not lo) and (end < hi or hi == len(s)):
            found[begin, end] = min(p, found.get((begin, end), p))

    while todo:
        lo, hi = todo.pop()
        if hi - lo < min_length:
            continue
        m = (lo + hi) // 2
        u, v = s[lo:m], s[m:hi]
        n, o = len(u), len(v)
        z = z_array([*v, -1, *u])
        ahead, ahead_u = [*z[:o], 0], z[o + 1 :]
        z = z_array([*u[::-1], -1, *v[::-1]])
        back, back_v = [*z[:n], 0], z[n + 1 :]
        for p in range(1, min((hi - lo) // exponent, n, o) + 1):
            if (left := back_v[o - p]) == p:  # the period starts at the middle
                left += back[p]
            run(m - left, m + p + ahead[p], p)
            if (right := ahead_u[n - p]) == p:  # the period ends at the middle
                right += ahead[p]
            run(m - p - back[p], m + right, p)
        todo += [(lo, m), (m, hi)]
    return sorted((begin, end, p) for (begin, end), p in found.items())


def _repeated(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Mask of the words that lie in a k-gram that occurs twice in its group; first: where groups begin, and the end."""
    g = B.grams(h, k)
    at = np.flatnonzero(B.in_document(first, k, len(g)))
    group = np.repeat(np.arange(len(first) - 1, dtype=B.U64), np.diff(first))
    key = B.mix(g[at] + B.mix(group[at] + B.U64(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = at[twice]
    return B.covered(len(h), at, at + k)


def segments(h: np.ndarray, first: np.ndarray, k: int, min_length: int) -> list[tuple[int, int]]:
    """Stretches of words that may hold runs, by masking within documents and then within what that leaves."""
    begin, end = B.stretches(_repeated(h, first, k), first) if len(h) else (h, h)
    whole = end - begin >= min_length
    begin, end = begin[whole], end[whole]
    if not len(begin):
        return []
    size = end - begin
    place = np.concatenate([[0], np.cumsum(size)])
    word = np.arange(place[-1]) + np.repeat(begin - place[:-1], size)
    lo, hi = B.stretches(_repeated(h[word], place, k), place)
    whole = hi - lo >= min_length
    return list(zip(word[lo[whole]].tolist(), (word[hi[whole] - 1] + 1).tolist(), strict=True))


def scan(text: pa.Array, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs (start, length, period), text that is left) of each text."""
    k = least_overlap(min_length, exponent)
    for lo, hi in B.slices(text):
        buf, offs = B.raw(text.slice(lo, hi - lo))
        starts, ends, first = B.word_spans(buf, offs, B.NOT_BLANK)
        h = B.span_hashes(buf, starts, ends)
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in segments(h, first, k, min_length):
            _, code = np.unique(h[a:b], return_inverse=True)
            if found := main_lorentz(code.tolist(), min_length, exponent):
                doc = int(np.searchsorted(first, a, "right")) - 1
                runs.setdefault(doc, []).extend((a + x - int(first[doc]), y - x, q) for x, y, q in found)
        for d in range(hi - lo):
            n, data = int(first[d + 1] - first[d]), buf[offs[d] : offs[d + 1]].tobytes()
            words = data.split()  # at the blanks of NOT_BLANK
            if d in runs:
                gone = B.covered(n, np.array([x + q for x, _, q in runs[d]]), np.array([x + m for x, m, _ in runs[d]]))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            yield n, runs.get(d, []), b" ".join(words)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id_col, n_words, runs (by start, then period) and collapsed (words that stay, joined by one space)."""
    if min_length < 2 or exponent < 2:
        raise ValueError("runs have two words and two periods at least")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    of_run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(scan(B.text_array(batch.column(1)), min_length, exponent))
            runs = [[{"start": a, "length": n, "period": q} for a, n, q in sorted(r, key=lambda x: (x[0], x[2]))] for _, r, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array(runs, of_run), pa.array([t for _, _, t in found], pa.binary()).cast(pa.string())], ["_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"_id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("_id", id_col)
