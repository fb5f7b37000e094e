"""Inverted treaps against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corvane.llm import queries, ranked
from corvane.llm.treaps import Treaps, cartesian

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("ranks", [[5], [1, 2, 3], [3, 2, 1], [4, 9, 1, 7, 3, 8]])
def test_heap_and_search_order(ranks):
    root, left, right = cartesian(ranks)

    def walk(i):
        if i < 0:
            return []
        assert all(c < 0 or ranks[c] < ranks[i] for c in (left[i], right[i]))
        return [*walk(left[i]), i, *walk(right[i])]

    assert walk(root) == list(range(len(ranks)))


@pytest.mark.parametrize("seed", range(6))
def test_best_of_a_shard(seed):
    rng = np.random.default_rng(seed)
    docs, n_terms = int(rng.choice([40, 700, 5000])), 12
    cell = np.unique(rng.integers(0, docs * n_terms, docs * 3))
    term, doc = cell // docs, cell % docs
    impact = rng.integers(1, [3, 1000, 900_000][seed % 3], len(cell))
    treaps = Treaps(term, doc, impact, n_terms, docs)
    for k in (1, 7, 50):
        some = rng.choice(n_terms, 5, replace=False)
        weight = rng.integers(1, 9000, 5)
        full = np.zeros(docs, np.int64)
        for t, w in zip(some, weight, strict=True):
            np.add.at(full, doc[term == t], impact[term == t] * w)
        want = sorted(((-s, d) for d, s in enumerate(full.tolist()) if s))[:k]
        got = treaps.search(some, weight, k)
        assert list(zip((-got[1]).tolist(), got[0].tolist(), strict=True)) == want
        floor = -want[len(want) // 2][0]
        got = treaps.search(some, weight, k, floor)
        assert list(zip((-got[1]).tolist(), got[0].tolist(), strict=True)) == [x for x in want if -x[0] >= floor]


def test_subtrees_are_pruned(monkeypatch):
    rng = np.random.default_rng(9)
    docs = 20_000
    doc, impact = np.tile(np.arange(docs), 3), rng.integers(1, 100, 3 * docs)
    impact[::2000] = 900_000
    treaps, seen = Treaps(np.repeat(np.arange(3), docs), doc, impact, 3, docs), []
    whole = Treaps._whole
    monkeypatch.setattr(Treaps, "_whole", lambda self, terms, weight, lo, hi: seen.append(int((hi - lo + 1).sum())) or whole(self, terms, weight, lo, hi))
    treaps.search(np.arange(3), np.array([5, 7, 9]), 5)
    assert sum(seen) < docs / 10


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["été", "日本", "The", "I"]
    text = lambda m: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=m)) + rng.choice(["", ".", "-x", "\x1f"])
    return text, [(i, text(rng.randrange(1, 80))) for i in range(n)]


@pytest.mark.parametrize(("posts", "cut"), [(1 << 22, 1 << 22), (500, 2000)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, posts, cut):
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", posts)
    monkeypatch.setattr(ranked, "SLICE_BYTES", cut)
    text, docs = corpus(1, 400)
    docs += [(500, None), (501, ""), (502, " -- "), (503, docs[3][1]), (504, docs[3][1]), (7, docs[7][1]), (None, docs[9][1]), (505, docs[3][1] * 300)]
    items = [("a", text(8)), ("b", text(30)), ("b", text(30)), ("c", docs[3][1]), ("d", docs[3][1]), ("e", None), ("f", "unknown words"), (None, text(4)), ("g", "w1 w1 W1")]
    spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, _id string, score int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*i, 2) for i in items], "item_id string, text string, rank int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op11_inverted_treaps(spark, str(tmp_path))
    assert [c for c, _ in got.dtypes] == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_blocks_of_queries(spark):
    text, docs = corpus(2, 80)
    items = [(f"i{i}", text(6)) for i in range(12)]
    index = ranked.build(spark.createDataFrame(docs, "doc_id long, text string"))
    got = ranked.search(index, spark.createDataFrame(items, "item_id string, text string"), 5, block_bytes=150)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 5)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "b")], "item_id string, text string")
    assert ranked.search(ranked.build(none), items).count() == 0
    assert ranked.search(ranked.build(spark.createDataFrame([(1, "b")], "doc_id long, text string")), items.limit(0)).count() == 0
