"""What the fuzzy line operator leaves out: small buckets after the first pass, texts of lines that have met, shingles that are short of a hash's steps."""

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import bytesops, linededup, shared

from test_lines import rows_of_a_template
from test_operators import brute_lines


def packed(part, kind, rows):
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([np.array(rows, np.int64).tobytes()], pa.binary())], ["_part", "_kind", "_data"])


def met(batches, **more):
    rows = [r for x in linededup._meet(linededup.Settings(**more))(iter(batches)) for r in x.to_pylist()]
    return {(r["_key"], r["_l1"]): r["_many"] for r in rows}


def test_buckets_of_less_than_four_lines_are_marked():
    some = packed(0, 0, [(1, 10), (1, 11), (2, 20), (2, 21), (2, 22), (3, 30), (3, 31), (3, 32), (3, 33), (4, 40)])
    assert met([some]) == {(1, 11): False, (2, 21): False, (2, 22): False, (3, 31): True, (3, 32): True, (3, 33): True}
    # Lines of bucket 1 have met in a task already: all that are met here belong to a bucket of four or more.
    assert met([some, packed(0, 1, [(1, 13, 12, 12), (1, 14, 12, 13)])])[1, 11]
    assert met([packed(0, 1, [(1, 13, 12, 12), (1, 14, 12, 13)]), some])[1, 11]
    assert not met([packed(0, 1, [(1, 13, 12, 12), (1, 14, 12, 13)]), packed(1, 0, [(9, 1), (9, 2)])])[9, 2]
    # A reader that has let lines meet before the end of its range can't tell.
    assert met([packed(0, 0, [(1, 10), (1, 11)]), packed(0, 0, [(1, 12), (1, 13)])], held=2) == {(1, x): True for x in (11, 12, 13)}


def test_texts_are_joined_to_mixed_buckets_only(spark):
    rows = rows_of_a_template()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s = linededup.Settings()
    with shared.recorded() as made:
        got = {(r["doc_id"], p) for r in linededup.dedup_lines(df, s).collect() for p in r["_removed"]}
    assert got == brute_lines(rows, s)
    assert not any("/rooted-" in path for path in made)


@pytest.mark.parametrize("word", [np.uint32, bytesops.U64])
@pytest.mark.parametrize("k", [1, 3, 8, 21])
def test_shingles_of_few_bytes(k, word):
    for data in (b"a\n", b"ab\n", b"\na\n", "é\n\U0001f600\n".encode()):
        shingle, at = linededup.line_shingles(data, k, word)
        lines = data.decode().split("\n")[:-1]
        assert np.diff(at).tolist() == [max(len(x) - k + 1, min(len(x), 1)) for x in lines]
        assert len(shingle) == at[-1] and shingle.dtype == word


def test_columns_of_shingles_that_share_a_place():
    rng = np.random.default_rng(31)
    table = np.zeros(1 << linededup._PLACES, np.int64)
    some = rng.integers(0, 1 << 40, 300, dtype=np.uint64) | (rng.integers(0, 90, 300, dtype=np.uint64) << np.uint64(48))
    for _ in range(3):
        x = rng.choice(some, 2000)
        column = linededup.columns(x, table)
        assert column.max() < 2 * len(x)
        assert len({*zip(x.tolist(), column.tolist(), strict=True)}) == len({*x.tolist()}) == len({*column.tolist()})


def test_mixed_buckets_by_pairs_and_by_products_find_the_same():
    """Buckets of 2 to 40 lines of one template; where few pairs are left, they are compared singly."""
    rng = np.random.default_rng(32)
    base = rng.choice(list("abcdefgh"), 90)
    lines = []
    for _ in range(400):
        x = base.copy()
        x[rng.choice(90, 2, replace=False)] = rng.choice(list("xyz"), 2)
        lines.append("".join(x).encode())
    member = [rng.choice(400, n, replace=False) for n in rng.integers(2, 41, 60).tolist()]
    key, no = np.repeat(np.arange(60), [len(m) for m in member]), np.concatenate(member)
    root = np.where(rng.random(400) < 0.7, np.arange(400) % 3, np.arange(400))
    s = linededup.Settings()
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(no), pa.array(root[no]), pa.array([lines[i] for i in no], pa.binary())], ["_key", "_no", "_root", "_line"])
    got = {(a, b) for x in linededup._met_whole(s)(iter([rows])) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
    sets = [{x[i : i + s.k] for i in range(len(x) - s.k + 1)} for x in lines]
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= s.percent * len(sets[a] | sets[b])
    want = {(int(a), int(b)) for m in member for a in m for b in m if root[a] > root[b] and near(a, b)}
    assert got == want and want
