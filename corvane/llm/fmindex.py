"""A compressed FM-index over word sequences, with matching statistics for many queries in lock-step.

The indexed texts are joined with a separator; the suffix array is built by prefix doubling, its Burrows-Wheeler
transform is held in a wavelet matrix (one bit vector for each bit of a word's number, with popcount rank), and a
backward-search step is one pass over the levels. Each text has a weight, the number of times that it occurs; an
interval's weight, by prefix sums over the suffix array, says how often a sequence occurs in the corpus.
"""

from __future__ import annotations

import numpy as np

from .bytesops import U64


def suffix_array(t: np.ndarray) -> np.ndarray:
    n = len(t)
    _, rank = np.unique(t, return_inverse=True)
    rank, k = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank, k = new, 2 * k
        if k >= n or rank[order[-1]] == n - 1:
            return order


class BitVector:
    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        w = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, a: np.ndarray, symbols: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            b = (a >> bit) & 1 == 1
            zeros = int(len(b) - b.sum())
            self.levels.append((bit, BitVector(b), zeros))
            a = np.concatenate([a[~b], a[b]])
        self.base = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            r = bits.rank(i)
            i = np.where((c >> bit) & 1 == 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        return self._walk(c, i) - self.base[c]


class FMIndex:
    """Index of texts (arrays of word hashes) that occur `weights` times each."""

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray):
        size = np.array([len(x) for x in texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        flat = np.concatenate(texts) if texts else np.zeros(0, U64)
        words, number = np.unique(flat, return_inverse=True)
        t = np.zeros(int(self.at[-1]), np.int64)  # 0 separates
        inner = np.ones(len(t), bool)
        inner[self.at[1:] - 1] = False
        t[inner] = number + 1
        w = np.zeros(len(t), np.int64)
        w[inner] = np.repeat(np.asarray(weights, np.int64), size)
        sa = suffix_array(t)
        self.text, self.n = t, len(t)
        self.weight = np.concatenate([[0], np.cumsum(w[sa])])
        symbols = len(words) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))])
        self.bwt = WaveletMatrix(t[sa - 1], symbols)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the sequences with word c before those of [lo, hi)."""
        both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]

    def repeated(self, span: int, least: int = 2) -> list[list[tuple[int, int]]]:
        """For each indexed text, streamed as a query, the intervals [a, b) of `span` or more words that occur `least` times.

        A query ends at word e and is extended to the left while it occurs often enough; what it reaches is the matching
        statistic of e. It moves left word by word until a first interval is long enough (what occurs to its left can
        only end within span - 2 words of its start), then goes on from the left end of the text, where each failure at
        word f rules out every window that holds both f and e.
        """
        n_text = len(self.at) - 1
        begin, end = self.at[:-1], self.at[1:] - 1
        out: list[list[tuple[int, int]]] = [[] for _ in range(n_text)]
        q = np.flatnonzero(end - begin >= span)
        e = end[q] - 1  # last word of the query
        f = e + 1  # first word that is in the match
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), self.n)
        forward = np.zeros(len(q), bool)
        limit = end[q].copy()  # when going forward: windows that start before it are open
        while len(q):
            can = f > begin[q]
            a, b = lo.copy(), hi.copy()
            if can.any():
                a[can], b[can] = self.extend(self.text[f[can] - 1], lo[can], hi[can])
            grown = can & (self.weight[b] - self.weight[a] >= least)
            # Going forward, a query ends at its window's start.
            reached = grown & forward & (e - (f - 1) + 1 >= span)
            lo[grown], hi[grown], f[grown] = a[grown], b[grown], f[grown] - 1
            stop = ~grown | reached
            if not stop.any():
                continue
            s = np.flatnonzero(stop)
            long_ = e[s] - f[s] + 1 >= span
            for i in s[long_].tolist():
                out[q[i]].append((int(f[i] - begin[q[i]]), int(e[i] + 1 - begin[q[i]])))
            fw = forward[s]
            back_hit, back_miss = s[~fw & long_], s[~fw & ~long_]
            ahead = s[fw]
            e[back_miss] -= 1
            forward[back_hit], limit[back_hit] = True, f[back_hit]
            e[back_hit] = begin[q[back_hit]] + span - 1
            e[ahead] = np.where(e[ahead] - f[ahead] + 1 >= span, e[ahead] + 1, f[ahead] - 1 + span)
            f[s], lo[s], hi[s] = e[s] + 1, 0, self.n
            start = e - span + 1
            done = np.zeros(len(q), bool)
            done[s] = np.where(forward[s], start[s] >= np.minimum(limit[s], end[q[s]] - span + 1), start[s] < begin[q[s]])
            if done.any():
                k = ~done
                q, e, f, lo, hi, forward, limit = q[k], e[k], f[k], lo[k], hi[k], forward[k], limit[k]
        return out
