"""Periodic runs against a brute-force version."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from corvane.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(words, min_length=6, exponent=4):
    """(start, length, period) of each run, by comparing words one period apart for every period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def left(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def row(doc_id, words):
    runs = runs_of(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(left(words, runs)))


@pytest.mark.parametrize(("min_length", "exponent"), [(6, 4), (4, 2), (9, 3), (2, 2)])
def test_runs_of_random_words(min_length, exponent):
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        words = [str(rng.randrange(rng.choice([1, 2, 3, 9]))) for _ in range(rng.randrange(70))]
        if len(words) > 8:
            p, a = rng.randint(1, 7), rng.randrange(len(words))
            for i in range(a + p, min(len(words), a + rng.randint(1, 50))):
                words[i] = words[i - p]
        texts.append(" ".join(words))
    for text, (n, runs, kept) in zip(texts, periodic.scan(pa.array(texts), min_length, exponent), strict=True):
        want = runs_of(text.split(), min_length, exponent)
        assert (n, sorted(runs), kept.decode()) == (len(text.split()), want, left(text.split(), want))


def test_main_lorentz_needs_no_mask():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.randrange(2) for _ in range(rng.randrange(40))]
        assert [(a, b - a, q) for a, b, q in periodic.main_lorentz(words)] == runs_of(words)


def test_words_outside_repeated_grams_are_masked():
    text = " ".join(["a b c d e f g h"] + ["x y"] * 6 + ["i j k a b c d e f g"])
    calls = []
    whole = periodic.main_lorentz
    try:
        periodic.main_lorentz = lambda s, *a: calls.append(len(s)) or whole(s, *a)
        (_, runs, _), = periodic.scan(pa.array([text]))
    finally:
        periodic.main_lorentz = whole
    assert runs == [(8, 12, 2)] and calls == [12]  # a to g repeats, but not within its own segment


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \n ", "one", "a " * 5, "a " * 6, "a b " * 30, "été ja " * 9, "Same line\nSame line\n" * 20, " ".join(rng.choice(["a", "b"]) for _ in range(3000)), "\v\f".join(["x", "y", "z"] * 40)]
    texts += [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(200))) for _ in range(250)]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(9, texts[9], "a", "b"), (None, "z " * 20, "a", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, _text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [row(i, planted(i, t) if i is not None else WORD.findall(t)) for i, t, _, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 20


def test_no_rows(spark):
    assert periodic.collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
