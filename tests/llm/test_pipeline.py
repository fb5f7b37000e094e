"""The pipeline's stages, each on its own input, against what they must keep."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_operators import ALNUM, LOWER, TEXTS, WORD, brute_components, brute_lines, shingles

import corpus_pipeline
from corvane.llm import bytesops, chat, classifier, linededup
from corvane.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def staged(spark, small, tmp_path_factory):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, small).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_stages_keep_columns_and_rows(staged):
    for before, after in staged[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS
        assert after.join(before, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= before.count()
    assert staged[1][1].filter("n_chars <> length(text)").count() == 0


def test_quality_rejects_by_the_votes(spark, small, staged):
    """Each document by the exact cosines of its vector with every labelled vector."""
    before, after = staged[0]
    model = classifier.fit(before, spark.read.parquet(f"{small}/labels.parquet"))
    rows = before.select("doc_id", "text").collect()
    x = classifier.features(*bytesops.raw(pa.array([r["text"] or "" for r in rows])))
    stays, known = {r["doc_id"] for r in after.collect()}, model.known.astype(float)
    for r, v in zip(rows, x, strict=True):
        z = (v * model.scale - model.mean).astype(float) @ model.basis.astype(float)
        cos = known @ z / np.linalg.norm(known, axis=1) / max(np.linalg.norm(z), 1e-9)
        near = np.argsort(-cos, kind="stable")[: model.s.neighbours]
        w = np.maximum(cos[near], 1e-3) ** model.s.sharpness * model.vote[near]
        score = float(w @ model.label[near] / w.sum())
        assert abs(score - corpus_pipeline.REJECT_BELOW) < 1e-3 or (r["doc_id"] in stays) == (score >= corpus_pipeline.REJECT_BELOW)
    assert 0 < len(stays) < len(rows)


def test_lines_leave_the_first_of_each_group(staged):
    before, after = staged[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    gone, expected = brute_lines(rows, linededup.Settings()), {}
    for i, t in rows:
        left = [x for pos, x in enumerate((t or "").split("\n")) if (i, pos) not in gone]
        if len(left) == len((t or "").split("\n")):
            expected[i] = t
        elif WORD.search("\n".join(left)):
            expected[i] = "\n".join(left)
    assert gone and {r["doc_id"]: r["text"] for r in after.collect()} == expected


def test_decontaminate_drops_documents_with_a_window(spark, small, staged):
    before, after = staged[3]
    windows = {}
    for (t,) in spark.read.parquet(f"{small}/benchmark.parquet").select("text").collect():
        v = ALNUM.findall((t or "").translate(LOWER))
        n = min(len(v), 10)
        windows.setdefault(n, set()).update(tuple(v[i : i + n]) for i in range(len(v) - n + 1))
    windows.pop(0, None)
    clean = set()
    for r in before.collect():
        w = ALNUM.findall((r["text"] or "").translate(LOWER))
        if not any(tuple(w[i : i + n]) in some for n, some in windows.items() for i in range(len(w) - n + 1)):
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == clean and len(clean) < before.count()


AWKWARD = [(i, t, None, None if i % 3 else "s", None) for i, t in enumerate(TEXTS)]
AWKWARD += [AWKWARD[9], AWKWARD[9], (None, None, None, None, None), (None, "no id at all, but a text of its own", "en", "s", 7), (None, "no id either", "en", "s", 7)]
CLASHING = ["_id", "_text", "_score", "_removed", "_kept_text", "_t", "_stays", "_spans", "_part", "kept", "host", "component_id", "sequence_id"]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, small, name, stage):
    """Nulls in every column, empty and long texts, repeated rows, columns that clash, no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(AWKWARD, schema).repartition(3)
    for i, c in enumerate(CLASHING):
        docs = docs.withColumn(c, docs["doc_id"] + i)
    out = stage(spark, docs, small)
    got = out.select("doc_id").collect()
    ids = [r["doc_id"] for r in got]
    if name == "pack":
        assert set(ids) == {r[0] for r in AWKWARD} and out.groupBy().sum("length").first()[0] > len(AWKWARD)
    else:
        assert out.columns == corpus_pipeline.COLUMNS
    if name == "quality":  # rows of equal text have one fate
        assert ids.count(9) in (0, 3) and len(ids) <= len(AWKWARD)
    if name == "lines":  # null and empty texts stay; rows equal in id and text are decided alike; texts whose only line goes, go
        gone = {i for i, _ in brute_lines([r[:2] for r in AWKWARD if r[0] not in (None, 7, 20)], linededup.Settings())}
        assert gone == {13, 14, 15, 16, 19} and set(ids) == {r[0] for r in AWKWARD} - gone and ids.count(9) == ids.count(None) == 3
    if name == "near_dups":  # rows equal in id and text are one document
        assert ids.count(9) == 1 and {0, 1, 2} <= set(ids) and ids.count(None) == 3
    if name == "decontaminate":
        assert ids.count(9) in (0, 3) and {0, 1, 2, None} <= set(ids)
    assert stage(spark, docs.limit(0), small).count() == 0


def test_near_dups_leave_one_of_each_group(staged):
    before, after = staged[2]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    kept = {r[0] for r in brute_components(rows, 80) if r[3]}
    assert {r["doc_id"] for r in after.collect()} == kept
    assert any(shingles(t) for _, t in rows)


def test_near_dups_link_from_80_percent(spark, small):
    """Copies at Jaccard 0.77 to 0.91; those of 0.80 to 0.85 are what a threshold of 85 leaves in."""
    rng = np.random.default_rng(21)
    rows = []
    for group in range(30):
        base = [f"g{group}w{i}" for i in range(200)]
        rows.append((len(rows), " ".join(base)))
        for n in (2, 3, 4, 5):
            t = list(base)
            for i in rng.choice(np.arange(5, 195, 10), n, replace=False):
                t[i] = f"x{len(rows)}y{i}"
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dups(spark, df, small).collect()}
    assert kept == {r[0] for r in brute_components(rows, 80) if r[3]} and kept < {r[0] for r in brute_components(rows, 85) if r[3]}


def test_packed_pieces_cover_all(staged):
    before, after = staged[4]
    assert after.select("doc_id").distinct().count() == before.count()
    assert after.groupBy("doc_id", "doc_tokens").sum("length").filter("`sum(length)` <> doc_tokens").count() == 0


def test_run_is_the_stages(spark, small, staged):
    pick = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert pick(corpus_pipeline.run(spark, small)) == pick(staged[4][1])


def test_chat_query_visits_parts(spark, small, monkeypatch):
    seen, visit = [], chat.visit_parts
    monkeypatch.setattr(chat, "visit_parts", lambda parts: seen.append(parts) or visit(parts))
    assert QUERIES["op8_chat_parts"](spark, small).count() > 0 and seen


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, small, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = QUERIES[name](spark, small)
    cols = sorted(got.columns)
    expected = db.sql(ORACLE[name])
    assert cols == sorted(expected.columns)
    digest = lambda rows: sorted(hashlib.md5(repr(tuple(r)).encode()).hexdigest() for r in rows)  # noqa: E731  rows, as data frames tell nulls among whole numbers apart
    assert digest(got.select(*cols).collect()) == digest(expected.select(*[f'"{c}"' for c in cols]).fetchall())
