"""Blocks made of documents instead of postings."""

import numpy as np
import pytest

from corvane.operators import postings


@pytest.mark.parametrize("held", [1, 7, 1 << 21])
def test_blocks_of_documents(spark, held):
    texts = ["bbb aaa bbb ccc", "", "aaa", "ddd " * 300 + "aaa", "zzz yyy zzz"]
    t = spark.createDataFrame([(d, x.split()) for d, x in zip([9, 3, 9, 70000, -5], texts, strict=True)], "doc long, terms array<string>")  # two rows are document 9, of 5 terms together
    made = postings.blocks(t, 2.0, size=2, held=held).collect()
    found = {}
    for b in made:
        doc = b["first"] + np.cumsum(postings.unpack(b["docs"]))
        assert (doc[0], doc[-1], len(doc)) == (b["first"], b["last"], b["n"]) and b["n"] <= 2 and {int(d) >> postings.SHARD_BITS for d in doc} == {b["shard"]}
        for d, tf, n in zip(doc.tolist(), postings.unpack(b["tfs"]).tolist(), postings.unpack(b["lens"]).tolist(), strict=True):
            assert (b["term"], d) not in found
            found[b["term"], d] = tf, n
    assert found == {("bbb", 9): (2, 5), ("aaa", 9): (2, 5), ("ccc", 9): (1, 5), ("ddd", 70000): (300, 301), ("aaa", 70000): (1, 301), ("zzz", -5): (2, 3), ("yyy", -5): (1, 3)}


def test_packed_is_pack_of_each(spark):
    values = np.array([0, 127, 128, 1 << 20, 1 << 50, 5, 0], np.int64)
    begin = np.array([0, 3, 6])
    assert postings.packed(values, begin).to_pylist() == [postings.pack(values[a:b]) for a, b in ((0, 3), (3, 6), (6, 7))]
