"""Terms counted within their row."""

import re

from pyspark.sql import functions as F

from corvane import queries
from corvane.operators import bm25, retrieval
from corvane.session import shared_path

TEXTS = ["bbb aaa bbb ccc", "", "aaa", "ddd " * 300 + "aaa", "zzz yyy zzz"]


def terms(spark, docs):
    rows = [(d, t.split()) for d, t in zip(docs, TEXTS, strict=True)]
    return spark.createDataFrame(rows, "doc long, terms array<string>")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_counts_within_a_row(spark):
    t = terms(spark, range(5))
    once, grouped = bm25.term_frequencies(t, True), bm25.term_frequencies(t)
    assert once.schema.fieldNames() == grouped.schema.fieldNames() and once.dtypes == grouped.dtypes
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, grouped.collect()))
    assert sorted(map(tuple, bm25.row_frequencies(t).collect())) == sorted(map(tuple, bm25.document_frequencies(grouped).collect()))
    for docs in (range(5), [0, 1, 2, 0, None], [None, None, 1, 1, 1]):
        t = terms(spark, docs)
        assert sorted(map(tuple, bm25.token_frequencies(t).collect())) == sorted(map(tuple, bm25.document_frequencies(bm25.term_frequencies(t)).collect()))
    assert bm25.term_frequencies(t.select("doc", F.lit(None).cast("array<string>").alias("terms")), True).count() == 0
    assert bm25.unique(terms(spark, range(5)), "doc") and not bm25.unique(terms(spark, [0, 1, 2, 1, 4]), "doc")


def test_postings_are_not_shuffled(spark, small):
    assert "hashpartitioning(term" not in plan(queries.bm25_postings(spark, small))
    assert not [x for x in re.findall(r"hashpartitioning\((.*?)\)", plan(queries.bm25_child_frequencies(spark, small))) if "doc" in x]


def test_repeated_ids(spark, small):
    """Rows of one id are one document for postings, and chunks of their own for what an index holds."""
    path = shared_path(spark, "repeated")
    docs = spark.createDataFrame([(1, "alpha beta " * 20), (1, "alpha gamma " * 20), (2, "alpha")], "doc_id long, text string")
    docs.write.parquet(f"{path}/documents.parquet")
    docs.limit(0).write.parquet(f"{path}/benchmark.parquet")
    assert {r["term"]: r["df"] for r in queries.bm25_document_frequencies(spark, path).collect()} == {"alpha": 2, "beta": 1, "gamma": 1}
    assert {(r["term"], r["doc"]): r["tf"] for r in queries.bm25_postings(spark, path).collect()}["alpha", 1] == 40
    assert {r["term"]: r["df"] for r in queries.bm25_child_frequencies(spark, path).collect()}["alpha"] == 2  # the third is too short for a chunk


def test_scores_bring_lengths(spark):
    t = terms(spark, range(5))
    lengths, tf = bm25.doc_lengths(t), bm25.term_frequencies(t)
    asked = spark.createDataFrame([(1, "aaa zzz aaa"), (2, "ccc nothing"), (3, "")], "query_id long, text string")
    score = lambda *a: {(r["query_id"], r["doc"]): round(r["score"], 9) for r in retrieval.bm25_scores(asked, *a, bm25.document_frequencies(tf), 5, 61.0).collect()}
    assert score(bm25.term_frequencies(t.withColumn("len", F.size("terms")), True, "len"), None) == score(tf, lengths) != {}
