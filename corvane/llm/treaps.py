"""Inverted treaps of one shard: search order by document, heap order by impact.

The postings of all terms lie in one array each, sorted by (term, document). A term's treap is over its stretch of them:
in order of document from left to right, no child of greater impact than its parent (equal impacts are ordered by a hash
of the document, so that copies don't make a chain).

A search walks the treaps of its terms together. It holds intervals of documents, each with the topmost node of every
term in it. The sum of these nodes' weighted impacts bounds the score of every document there, so an interval whose sum
can't enter the best k goes with all its subtrees. Of the others, those of the highest bounds are split first, at the
document of the weightiest node: that is scored, and both sides go on with their own topmost nodes. An interval of few
documents is scored as a whole, as its postings lie side by side.
"""

from __future__ import annotations

import numpy as np

#: Intervals that are split at once, and documents of an interval that is scored as a whole.
STEP, LEAF = 256, 64


def cartesian(rank: list[int]) -> tuple[int, list[int], list[int]]:
    """(root, left, right) of the max-heap over distinct ranks whose in-order is theirs; -1 for none."""
    left, right, spine = [-1] * len(rank), [-1] * len(rank), []
    for i, r in enumerate(rank):
        last = -1
        while spine and rank[spine[-1]] < r:
            last = spine.pop()
        left[i] = last
        if spine:
            right[spine[-1]] = i
        spine.append(i)
    return spine[0], left, right


class Treaps:
    """term, doc, impact: postings sorted by term and document; terms are 0 to terms - 1, documents 0 to docs - 1."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int, docs: int):
        self.doc, self.impact, self.docs = doc.astype(np.int32), impact.astype(np.int32), docs
        self.begin = np.searchsorted(term, np.arange(terms + 1))
        tie = (np.arange(docs, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
        rank = (self.impact.astype(np.int64) << 32) | tie[self.doc]
        self.root = np.full(terms, -1, np.int32)
        self.left, self.right = np.full(len(doc), -1, np.int32), np.full(len(doc), -1, np.int32)
        for t in range(terms):
            a, b = int(self.begin[t]), int(self.begin[t + 1])
            if b > a:
                root, left, right = cartesian(rank[a:b].tolist())
                self.root[t] = a + root
                for mine, theirs in ((self.left, left), (self.right, right)):
                    x = np.array(theirs, np.int32)
                    mine[a:b] = np.where(x < 0, -1, x + a)

    def _topmost(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The topmost node at or under each node whose document is in lo to hi, or -1."""
        node, open_ = node.copy(), np.flatnonzero(node >= 0)
        while len(open_):
            at = node[open_]
            d = self.doc[at]
            low, high = d < lo[open_], d > hi[open_]
            at = np.where(low, self.right[at], np.where(high, self.left[at], at))
            node[open_] = at
            open_ = open_[(low | high) & (at >= 0)]
        return node

    def _whole(self, terms: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all documents with a posting in small intervals."""
        key = self.begin[terms][:, None], self.begin[terms + 1][:, None]
        first = np.stack([a + np.searchsorted(self.doc[a:b], lo) for a, b in zip(key[0].ravel(), key[1].ravel(), strict=True)])
        end = np.stack([a + np.searchsorted(self.doc[a:b], hi, "right") for a, b in zip(key[0].ravel(), key[1].ravel(), strict=True)])
        n = (end - first).ravel()
        upto = np.cumsum(n)
        at = np.arange(int(upto[-1])) + np.repeat(first.ravel() - (upto - n), n)
        share = self.impact[at] * np.repeat(np.repeat(weight, len(lo)), n)
        order = np.argsort(self.doc[at], kind="stable")
        d, share = self.doc[at][order], share[order]
        new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        return d[new], np.add.reduceat(share, new)

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best of floor or more, best first, equal scores by document. weight: of each of the distinct terms, above 0."""
        have = self.root[terms] >= 0
        terms, weight = terms[have], weight[have].astype(np.int64)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi, node = np.zeros(1, np.int32), np.full(1, self.docs - 1, np.int32), self.root[terms][None, :]
        impact = np.append(self.impact, 0).astype(np.int64)  # of node -1

        def taken(d: np.ndarray, s: np.ndarray) -> None:
            nonlocal docs, scores
            good = s >= floor
            d, s = np.concatenate([docs, d[good]]), np.concatenate([scores, s[good]])
            best = np.lexsort((d, -s))[:k]
            docs, scores = d[best], s[best]

        bound = impact[node] @ weight if len(terms) else np.zeros(0, np.int64)
        while len(bound):
            least, last = (scores[-1], docs[-1]) if len(docs) == k else (floor, self.docs)
            live = (bound >= floor) & ((bound > least) | (bound == least) & (lo < last))
            lo, hi, node, bound = lo[live], hi[live], node[live], bound[live]
            if not len(bound):
                break
            now = np.zeros(len(bound), bool)
            now[np.argpartition(-bound, STEP)[:STEP] if len(bound) > STEP else slice(None)] = True
            small = now & (hi - lo < LEAF)
            if small.any():
                taken(*self._whole(terms, weight, lo[small], hi[small]))
            cut = now & ~small
            a, b, at = lo[cut], hi[cut], node[cut]
            lo, hi, node, bound = lo[~now], hi[~now], node[~now], bound[~now]
            if not len(a):
                continue
            heavy = np.argmax(impact[at] * weight, 1)
            d = self.doc[at[np.arange(len(a)), heavy]]
            flat, each = at.ravel(), lambda x: np.repeat(x, len(terms))
            hit = self._topmost(flat, each(d), each(d)).reshape(at.shape)
            taken(d.astype(np.int64), impact[hit] @ weight)
            below = self._topmost(flat, each(a), each(d - 1)).reshape(at.shape)
            above = self._topmost(flat, each(d + 1), each(b)).reshape(at.shape)
            lo, hi, node = np.concatenate([lo, a, d + 1]), np.concatenate([hi, d - 1, b]), np.concatenate([node, below, above])
            bound = np.concatenate([bound, impact[below] @ weight, impact[above] @ weight])
        return docs, scores
