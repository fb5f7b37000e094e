"""A training corpus from documents: quality, lines, near duplicates, benchmark passages, packed sequences.

Each stage takes what its predecessor kept and returns the columns of `documents`, the last one the packed pieces.

    quality        documents that the neighbour classifier rejects (score < 0.3) go
    lines          of each group of near-equal lines one stays; a text that loses all its words goes
    near_dups      one document of each group of near duplicates (Jaccard 0.8) stays (the least id, then text hash)
    decontaminate  documents with a passage of the benchmark go
    pack           best-fit decreasing sequences of 4096 ids

A stage deletes the intermediate tables of the stage that was called before it, once its own docs don't read them: then the
former result has been written and read again. run() deletes each stage's tables as soon as its result is written.

n_chars always is the length of the text. Null texts count as empty: they keep their row until packing. Rows that are
equal in id and text are one document from the third stage on.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import classifier, decontaminate, linededup, neardup, packing
from corvane.llm.shared import delete, new_path, reads, recorded, scope
from corvane.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT_BELOW = 0.3
#: Near copies of Jaccard 0.8 or more; a link is missed with a chance of 3e-6 on 25 of 48 coordinates, of 9e-6 on 82 of 128.
NEAR = neardup.Settings(percent=80, screen_match=25, min_match=82)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _cleans_up(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not any(path.rstrip("/").endswith(old.split("://")[-1].rstrip("/")) for path in reads(docs) for old in _left):
            for path in _left:
                delete(spark, path)
            _left.clear()
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


@_cleans_up
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return classifier.score(docs.select(*COLUMNS), model, out_col="_score").filter(F.col("_score") >= REJECT_BELOW).drop("_score")


@_cleans_up
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = linededup.dedup_lines(docs.select(*COLUMNS))
    left = rows.filter((F.size("_removed") == 0) | F.col("_kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("text", F.col("_kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_cleans_up
def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = docs.select(*COLUMNS)
    stays = neardup.near_duplicates(docs, NEAR).filter("_stays").select(F.col("doc_id").alias("_kid"), F.col("_t").alias("_kt")).distinct()
    rows = docs.withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(stays, rows["doc_id"].eqNullSafe(stays["_kid"]) & (rows["_t"] == stays["_kt"])).dropDuplicates(["_kid", "_kt"]).select(*COLUMNS)


@_cleans_up
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = decontaminate.decontaminate(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"), keep_columns=True)
    return rows.filter(F.size("_spans") == 0).select(*COLUMNS)


@_cleans_up
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, 4096)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("lines", lines), ("near_dups", near_dups), ("decontaminate", decontaminated), ("pack", pack)]

#: A classifier, a tokenizer and fuzzy lines can't be said in SQL; tests hold the first four stages against brute force on small tables, packing by coverage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on `documents`, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scope(spark):  # what the stage wrote on its way goes when its result is there
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
