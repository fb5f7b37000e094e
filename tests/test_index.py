import json
import sqlite3
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.functions.vectors import dequantise, quantise
from corvane.operators import bm25, calibration, chunking, dedup, embedding, metadata, retrieval
from corvane.operators.calibration import calibrate
from corvane.plans.build import build_from_pages, build_index
from corvane.schemas import CALIBRATION_SEED
from corvane.sinks import outputs
from corvane.sources import container, files


def test_tokens(spark):
    df = spark.createDataFrame([("Hello World! foo_bar 123 ab",), ("Café naïve ÉTÉ",)], "x string")
    assert [r[0] for r in df.select(tokens(F.col("x"))).collect()] == [["hello", "world", "foo", "bar", "123"], ["caf"]]


def test_bm25_keeps_empty_documents(spark):
    child = spark.createDataFrame([(0, "Doc", "one one two"), (1, None, "two"), (2, None, "a b")], "doc long, t string, x string")
    terms = bm25.doc_tokens(child)
    tf = bm25.term_frequencies(terms)
    assert sorted(map(tuple, bm25.doc_lengths(terms).collect())) == [(0, 4), (1, 1), (2, 0)]
    assert sorted(map(tuple, tf.collect())) == [("doc", 0, 1), ("one", 0, 2), ("two", 0, 1), ("two", 1, 1)]
    assert {r["term"]: r["df"] for r in bm25.document_frequencies(tf).collect()} == {"doc": 1, "one": 1, "two": 2}
    assert {r["term"]: [tuple(p) for p in r["postings"]] for r in bm25.posting_lists(tf).collect()}["two"] == [(0, 1), (1, 1)]
    assert bm25.statistics(bm25.doc_lengths(terms)).first()["avg_doc_len"] == pytest.approx(5 / 3)
    assert bm25.statistics(bm25.doc_lengths(terms.limit(0))).first()["avg_doc_len"] == 0.0


def test_quantise_rounds_in_single_precision(spark):
    ties = [np.float32((k + 0.5) / 127) for k in range(-127, 127)]
    values = [0.5, -0.5, 1.5, -1.5, 0.004, *map(float, ties)]
    got = spark.createDataFrame([(values,)], "v array<float>").select(quantise(F.col("v")).alias("q"), dequantise(quantise(F.col("v"))).alias("d")).first()
    expected = np.clip(np.round(np.array(values, np.float32) * np.float32(127)), -127, 127)
    assert got["q"] == expected.astype(int).tolist()
    assert got["d"] == pytest.approx((expected / 127).tolist())


def greedy(v, thr):
    kept = []
    for i in range(len(v)):
        if all(float(v[i] @ v[j]) <= thr for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("thr", [0.2, 0.5, 0.95])
def test_greedy_collapse(spark, thr):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 6))
    v[40], v[90] = v[3], v[3] + 0.001
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos long, embedding array<double>")
    edges = {(r["a"], r["b"]) for r in dedup.near_edges(df, thr).collect()}
    assert edges == {(r["a"], r["b"]) for r in dedup.near_edges(df, thr, held_bytes=0).collect()}
    assert edges == {(i, j) for j in range(150) for i in range(j) if v[i] @ v[j] > thr}
    assert sorted(r["pos"] for r in dedup.drop_near_duplicates(df, thr).collect()) == greedy(v, thr)


@pytest.mark.parametrize("thr", [0.5, 0.98])
def test_edges_of_pivots_and_blocks(spark, thr):
    """Clusters, repeated vectors, nulls and vectors of another length; most pairs of groups are left out at 0.98."""
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(12, 8)), 20, 0) + rng.normal(size=(240, 8)) * 0.05
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, []), (302, [1.0, 0.0]), (303, [1.0, 0.1]), (304, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "pos long, embedding array<double>").repartition(3)
    edges = Counter((r["a"], r["b"]) for r in dedup.near_edges(df, thr, block=16, held_bytes=0).collect())
    assert edges == Counter((i, j) for j in range(240) for i in range(j) if v[i] @ v[j] > thr) + Counter({(302, 303): 1})


def test_calibration_of_a_sample(spark):
    """More rows than the sample: the drawn positions, each against all rows."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(620, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos long, embedding array<double>").repartition(3)
    dots = v @ v.T
    np.fill_diagonal(dots, -1.0)
    drawn = np.random.default_rng(CALIBRATION_SEED).choice(620, size=500, replace=False)
    best = np.maximum(dots[drawn].max(1), -1.0)
    got = calibrate(df, 620).first()
    assert got["sample_size"] == 500 and got["mean"] == pytest.approx(best.mean()) and got["std"] == pytest.approx(best.std())


@pytest.mark.parametrize("held", [retrieval.HELD_BYTES, 0])
def test_search_in_blocks(spark, held):
    """Held queries and cells give what one product gives: ties by id, nulls and other lengths apart, names as ids."""
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(90, 3)), 1)
    v[40:60] = v[20:40]
    rows = [(f"d{i:02}", x.tolist()) for i, x in enumerate(v)] + [("null", None), ("none", []), ("two", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "name string, e array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows) if i % 10 == 0 or i >= 90], "query_id long, vector array<double>")
    every = {(i, n): float(np.dot(x, y)) for i, x in asked.collect() for n, y in rows if x and y and len(x) == len(y)}
    assert len(every) == 9 * 90 + 1
    search = lambda **more: retrieval.cosine_scores(asked, df, "e", "name", held_bytes=held, block=4, **more)
    got = {(r["query_id"], r["doc"]): r["score"] for r in search().collect()}
    assert got.keys() == every.keys() and all(got[k] == pytest.approx(every[k], abs=1e-12) for k in got)
    best = retrieval.top_k(search(best=4).withColumn("score", F.round("score", 9)), 4)
    expected = {(i, n, k + 1) for i in {i for i, _ in every} for k, n in enumerate(sorted((n for j, n in every if j == i), key=lambda n: (-round(every[i, n], 9), n))[:4])}
    assert {(r["query_id"], r["doc"], r["rank"]) for r in best.collect()} == expected
    assert retrieval.cosine_scores(asked, df.limit(0), "e", "name", held_bytes=held).count() == retrieval.cosine_scores(asked.limit(0), df, "e", "name", held_bytes=held).count() == 0
    plan = search()._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_calibration_of_every_row_in_cells(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(70, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos long, embedding array<double>").repartition(3)
    dots = v @ v.T
    np.fill_diagonal(dots, -1.0)
    best = np.maximum(dots.max(1), -1.0)
    for held in (0, 1 << 20):
        got = calibrate(df, 70, sample=70, held_bytes=held).first()
        assert got["sample_size"] == 70 and got["mean"] == pytest.approx(best.mean()) and got["std"] == pytest.approx(best.std())


def test_parents_stay_in_their_row(spark):
    """Pages that repeat id and URL are cut apart, without a shuffle."""
    section = lambda text: [(None, text), ("More", text)]
    pages = spark.createDataFrame([(1, "https://a.b/c", "T", section("x" * 1300)), (1, "https://a.b/c", "T", section("y" * 60)), (2, None, "U", None)], "page_id long, url string, title string, sections array<struct<heading:string,text:string>>")
    out = chunking.parents(pages, "page_id")
    assert "Exchange" not in out._jdf.queryExecution().toString()
    got = sorted((r["local_pid"], r["t"], r["x"][0], len(r["x"])) for r in out.collect())
    assert got == sorted([(0, "T", "x", 1200), (1, "T", "x", 100), (2, "T -- More", "x", 1200), (3, "T -- More", "x", 100), (0, "T", "y", 60), (1, "T -- More", "y", 60)])


def test_nothing_to_collapse(spark):
    df = spark.createDataFrame([], "pos long, embedding array<double>")
    assert dedup.drop_near_duplicates(df).count() == 0


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.6, 0.0])], "pos long, embedding array<double>")
    for held in (0, dedup.HELD_BYTES):
        assert {(r["a"], r["b"]) for r in dedup.near_edges(df, 0.5, held_bytes=held).collect()} == {(0, 2)}


def test_parents_are_compacted(spark):
    parents = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pid long, x string")
    children = spark.createDataFrame([(0, 0), (1, 2), (2, 2)], "doc long, pid long")
    p, c = dedup.compact_parents(parents, children)
    assert sorted(map(tuple, p.select("pid", "x").collect())) == [(0, "a"), (1, "c")]
    assert sorted(map(tuple, c.select("doc", "pid").collect())) == [(0, 0), (1, 1), (2, 1)]


def test_calibration(spark):
    v = embedding.hash_embedder()([f"text {i}" for i in range(8)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos long, embedding array<float>")
    sims = v.astype(np.float64) @ v.T.astype(np.float64)
    np.fill_diagonal(sims, -1)
    r = calibration.calibrate(df, 8).first()
    assert (r["mean"], r["std"], r["sample_size"]) == (pytest.approx(sims.max(1).mean()), pytest.approx(sims.max(1).std()), 8)
    some = np.random.default_rng(42).choice(8, 3, replace=False)
    assert calibration.calibrate(df, 8, sample=3).first()["mean"] == pytest.approx(sims.max(1)[some].mean())
    assert tuple(calibration.calibrate(df, 1).first()) == (0.0, 0.0, 0)
    twin = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "pos long, embedding array<double>")
    assert calibration.calibrate(twin, 2).first()["mean"] == 1.0  # itself is left out by position, not by value


def page(title, *sections):
    return f"<title>{title}</title><nav><a href='/b'>b</a></nav><main>" + "".join(f"<h2>{h}</h2><p>{x}</p>" for h, x in sections) + "</main>"


@pytest.fixture(scope="module")
def index(spark):
    shared = "This notice stands in the same words on each page of the site and is only worth one entry in the index."
    web = spark.createDataFrame([("https://a.org", page("A", ("One", "Some words of the first page, long enough to be kept as a section of its own."), ("Notice", shared))), ("https://a.org/b", page("B", ("Two", "Other words of the second page, also long enough to be kept as a section."), ("Notice", shared)))], "url string, body string")
    return build_from_pages(spark, web, "https://a.org/")


def built(spark):
    parents = spark.createDataFrame([(0, "Doc -- One", "content one text", "https://a.org/a", "a.org", "page", 1.0), (1, "Doc -- Two", "content two text", "https://a.org/a", "a.org", "page", 1.0)], "pid long, t string, x string, u string, host string, kind string, weight double")
    return build_index(parents, parents.withColumn("doc", F.col("pid")), "Test Site", text=F.col("x"))


def test_container(spark, tmp_path):
    index = built(spark)
    for float32 in (False, True):
        path = str(tmp_path / f"index-{float32}.json")
        assert outputs.write_container(index, path, float32, "2026-01-01T00:00:00Z")
        data = open(path, "rb").read()
        (n,) = struct.unpack_from("<I", data)
        header = json.loads(data[4 : 4 + n])
        assert len(data) == 4 + n + 2 * 384 * (4 if float32 else 1)
        assert header["bm25"]["docLen"] == [5, 5] and header["bm25"]["df"] == {"doc": 2, "one": 1, "content": 2, "text": 2, "two": 1}
        assert header["bm25"]["postings"]["one"] == [[0, 2]] and header["bm25"]["avgDocLen"] == 5.0
        assert (header["v"], header["dims"], header["sourceCount"], header["site"]) == (2, 384, 1, "Test Site")
        assert ("vecsScale" in header) == (not float32) and header["calibration"]["sampleSize"] == 2
        again = container.read(spark, path)
        assert again.children(spark).select("pid").count() == 2 and again.parents(spark).count() == 2 and again.postings(spark).count() == 8
        v = embedding.hash_embedder()(["content one text"])[0]
        assert np.abs(again.vectors[0] - v).max() < (1e-7 if float32 else 0.5 / 127 + 1e-6)


def test_nothing_is_not_written(spark, tmp_path):
    index = built(spark)
    index.children = index.children.limit(0)
    assert not outputs.write_container(index, str(tmp_path / "none.json")) and not list(tmp_path.iterdir())


def test_site_build_collapses_shared_sections(index):
    assert index.site == "A"
    rows = index.children.orderBy("doc").collect()
    assert [r["t"] for r in rows] == ["A -- One", "A -- Notice", "B -- Two", "B -- Notice"]  # headings differ, so do vectors
    assert [r["pid"] for r in rows] == [0, 1, 2, 3]


def test_collapse_by_text(spark, index):
    again = build_index(index.parents, index.children.drop("embedding"), "A", text=F.col("x"))
    rows = again.children.orderBy("doc").collect()
    assert [(r["doc"], r["pid"], r["t"]) for r in rows] == [(0, 0, "A -- One"), (1, 1, "A -- Notice"), (2, 2, "B -- Two")]
    assert again.parents.count() == 3


def test_other_sinks(spark, index, tmp_path):
    outputs.write_parquet(index, f"{tmp_path}/tables")
    assert spark.read.parquet(f"{tmp_path}/tables/chunks").count() == 4
    outputs.write_sqlite(index, f"{tmp_path}/i.db")
    db = sqlite3.connect(f"{tmp_path}/i.db")
    assert db.execute("SELECT count(*), sum(length(v)) FROM vectors").fetchone() == (4, 4 * 384)
    assert db.execute("SELECT count(*) FROM bm25_postings WHERE term = 'notice'").fetchone() == (2,)
    parents = metadata.describe(index.parents).withColumn("local", F.col("pid") == 0)
    outputs.write_llms_txt(parents, f"{tmp_path}/llms", "Site")
    text = open(f"{tmp_path}/llms/llms-full.txt", encoding="utf-8").read()
    assert "A -- Notice" in text and "A -- One" not in text  # local rows stay out
    assert outputs.write_bundle(parents, f"{tmp_path}/okf", "Site", include_local=True).endswith("okf.zip")
    assert len(list((tmp_path / "okf" / "concepts").iterdir())) == 2


def test_search(spark, index):
    queries = spark.createDataFrame([(1, "second page")], "query_id int, text string")
    stats = bm25.statistics(index.lengths).first()
    scores = retrieval.bm25_scores(queries, index.tf, index.lengths, bm25.document_frequencies(index.tf), stats["docs"], stats["avg_doc_len"])
    best = retrieval.with_parents(retrieval.top_k(scores, 1), index.children, index.parents).first()
    assert best["parent_t"] == "B -- Two"
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc int, rank int")
    assert {r["doc"]: round(r["score"], 9) for r in retrieval.fuse(a, b).collect()} == {10: round(1 / 61, 9), 11: round(1 / 62 + 1 / 61, 9), 12: round(1 / 62, 9)}


def test_metadata(spark):
    df = spark.createDataFrame([(0, "T", "call 734-555-1234 or a@b.org, mrn: 123456", "https://github.com/o/r/blob/main/docs/README.md"), (1, None, "nothing here", "file:/home/x/a.txt"), (2, "V", "x", "https://www.youtube.com/watch?v=1")], "pid long, t string, x string, u string")
    rows = metadata.privacy_flags(metadata.describe(df)).orderBy("pid").collect()
    assert [r["source_type"] for r in rows] == ["github", "local", "youtube"]
    assert [r["content_type"] for r in rows] == ["readme", "page", "video_transcript"]
    assert rows[0]["categories"] == ["o", "r", "blob", "main", "docs"] and rows[0]["privacy_flags"] == ["phone", "email", "record_number"] and rows[1]["privacy_flags"] == []
    assert [r["pid"] for r in metadata.for_web(metadata.describe(df)).orderBy("pid").collect()] == [0, 2]


def test_local_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# A\n\ntext")
    (tmp_path / "b.bin").write_text("no")
    rows = files.local_files(spark, str(tmp_path)).collect()
    assert [(r["url"].endswith("sub/a.md"), r["body"], r["raw"]) for r in rows] == [(True, "# A\n\ntext", True)]


def test_copies_of_vectors_do_not_grow_with_the_table(spark, monkeypatch):
    from corvane.operators import blocks, dedup

    assert [-(-n // blocks.block_rows(n, 64)) for n in (100, 100_000, 1_000_000)] == [1, 16, 16]
    assert blocks.block_rows(10**9, 64) * 64 * 8 == blocks.BLOCK_BYTES
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 8)).astype("f4")
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, embedding array<float>")
    made, kept = [], dedup.keep
    monkeypatch.setattr(dedup, "keep", lambda t, name: (made.append((name, kept(t, name))), made[-1][1])[1])
    edges = {(r["a"], r["b"]) for r in dedup.near_edges(df, 0.3, block=8, held_bytes=0).collect()}
    assert edges == {(r["a"], r["b"]) for r in dedup.near_edges(df, 0.3).collect()} and edges
    cells = next(t for name, t in made if name == "cells").collect()
    assert [(r["g"], r["h"], r["nb"], r["nc"]) for r in cells] == [(0, 0, 16, 16)]  # 87 groups, none of them apart
