"""Delta builds against builds from nothing."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import bm25
from corvane.operators.segments import Segments
from corvane.session import shared_path


def site(spark, version):
    def text(i):
        edition = min(version, i % 3)
        return "\n\n".join(f"Section {n} of page {i} in edition {edition}, with enough words in it to make up a chunk of its own." for n in range(1 + (i * 7 + edition) % 9))

    rows = [(f"https://x.org/{i}", f"<title>Page {i}</title><main><h2>Head {i}</h2><p>{text(i)}</p></main>" if i % 10 else None, i * (1 if version < 2 else -1)) for i in range(30) if (i + version) % 5]
    return spark.createDataFrame(rows + rows[:1], "url string, body string, ord bigint")


def contents(held):
    parents, chunks = held.compact()
    return (
        sorted(map(tuple, parents.select("pid", "t", "x", "u").collect())),
        sorted(map(tuple, chunks.select("doc", "pid", "t", "x", "u", F.sha2(F.concat_ws(",", "embedding"), 256)).collect())),
        sorted(map(tuple, held.document_frequencies().collect())),
        held.statistics().first(),
    )


def test_deltas_are_a_build_from_nothing(spark):
    held = Segments(spark, shared_path(spark, "segments"))
    for version in range(3):
        held.apply(site(spark, version))
        anew = Segments(spark, shared_path(spark, "segments"))
        anew.apply(site(spark, version))
        assert contents(held) == contents(anew)
    assert contents(held.merged(shared_path(spark, "segments"))) == contents(anew)
    _, chunks = held.compact()
    tf = bm25.term_frequencies(bm25.doc_tokens(chunks))
    assert sorted(map(tuple, bm25.document_frequencies(tf).collect())) == sorted(map(tuple, held.document_frequencies().collect()))
    first, second, third = held.history().orderBy("segment_id").collect()
    assert first["dead"] == 0 and second["dead"] > 0 and third["embedded"] < third["chunks"] < first["chunks"]


def test_nothing_new_is_an_empty_segment(spark):
    held = Segments(spark, shared_path(spark, "segments"))
    held.apply(site(spark, 0))
    before = contents(held)
    held.apply(site(spark, 0))
    assert contents(held) == before
    assert tuple(held.history().filter("segment_id = 1").first()) == (1, 0, 0, 0, 0)


def test_failed_delta_leaves_no_trace(spark):
    held = Segments(spark, shared_path(spark, "segments"))
    held.apply(site(spark, 0))
    before, make = contents(held), held.make

    def broken():
        raise RuntimeError("no model")

    held.make = broken
    with pytest.raises(Exception, match="no model"):
        held.apply(site(spark, 1))
    assert held.committed() == 1 and contents(held) == before
    held.make = make
    held.apply(site(spark, 1))
    assert held.committed() == 2 and contents(held) != before


def test_empty_site(spark):
    held = Segments(spark, shared_path(spark, "segments"))
    held.apply(site(spark, 0).limit(0))
    assert held.compact()[1].count() == 0 and held.statistics().first()["docs"] == 0
    held.apply(site(spark, 1))
    held.apply(site(spark, 0).limit(0))
    assert held.compact()[1].count() == 0 and held.document_frequencies().count() == 0 and held.statistics().first()["avg_doc_len"] == 0
