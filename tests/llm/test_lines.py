"""Plans of the fuzzy line operator: what small mixed buckets need, and the narrow shingles of signatures."""

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import linededup, shared

from test_operators import brute_lines


def rows_of_a_template():
    """60 lines at Jaccard 0.7 or so to each other, 8 pairs above 0.8 among them, every third line twice."""
    rng = np.random.default_rng(21)
    base = rng.choice(list("abcdefghijk"), 400)

    def edited(x, n):
        x = x.copy()
        x[rng.choice(400, n, replace=False)] = rng.choice(list("lmnopqrstuvwxyz"), n)
        return x

    lines = [edited(base, 5) for _ in range(44)]
    for _ in range(8):
        both = edited(base, 3)
        lines += [edited(both, 2), edited(both, 2)]
    lines = ["".join(x) for x in lines]
    return [(int(i), lines[n]) for i, n in enumerate(rng.permutation(len(lines)))] + [(100 + i, lines[i].upper()) for i in range(0, 60, 3)]


@pytest.mark.parametrize(("whole", "prefixes"), [(1 << 20, False), (0, True)])
def test_small_mixed_buckets_meet_whole(spark, whole, prefixes):
    rows = rows_of_a_template()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s = linededup.Settings(whole=whole)
    with shared.recorded() as made:
        got = {(r["doc_id"], p) for r in linededup.dedup_lines(df, s).collect() for p in r["_removed"]}
    assert got == brute_lines(rows, s)
    assert any("/prefixes-" in path for path in made) == prefixes
    assert sum("/lines-" in path for path in made) == 1 and not any("/classes-" in path for path in made)


def test_buckets_that_are_cut_by_batches():
    rng = np.random.default_rng(22)
    lines = ["".join(rng.choice(list("ab"), 30)).encode() for _ in range(30_000)]
    key = np.sort(rng.integers(0, 6000, len(lines)))
    table = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(lines))), pa.array(np.arange(len(lines))), pa.array(lines, pa.binary())], ["_key", "_no", "_root", "_line"])
    s = linededup.Settings(k=2, percent=100)
    some = [table.slice(lo, 1000) for lo in range(0, len(lines), 1000)]
    got = {(a, b) for x in linededup._met_whole(s)(iter(some)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
    sets = [frozenset(x[i : i + 2] for i in range(29)) for x in lines]
    begin = np.searchsorted(key, np.arange(6001)).tolist()
    want = {(x, y) for lo, hi in zip(begin, begin[1:], strict=False) for x in range(lo, hi) for y in range(lo, x) if sets[x] == sets[y]}
    assert got == want and want


def test_narrow_shingles():
    data = "the quick brown fox\nshort\né中\U0001f600 the quick brown fox\n".encode()
    wide, at = linededup.line_shingles(data, 8)
    narrow, same = linededup.line_shingles(data, 8, np.uint32)
    assert narrow.dtype == np.uint32 and at.tolist() == same.tolist()
    pairs = lambda x: [(i, j) for i in range(len(x)) for j in range(i) if x[i] == x[j]]
    assert pairs(wide) == pairs(narrow) and pairs(wide)
