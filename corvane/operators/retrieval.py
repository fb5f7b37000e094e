"""Searching an index: BM25, cosine, rank fusion, z-scores, parent lookup.

These are extensions: the statistics and the container are what the index format defines; the formulas are public ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schemas import Bm25
from .blocks import BLOCK, as_given, block_rows, by_cell, matrix

#: Vectors or texts of queries that every task may hold.
HELD_BYTES = 32 << 20


def bm25_scores(queries: DataFrame, tf: DataFrame, lengths: DataFrame | None, df: DataFrame, docs: int, avg_len: float, p: Bm25 = Bm25()) -> DataFrame:
    """(query_id, doc, score) for queries (query_id, text): sum over distinct terms of idf * (d + tf (k + 1) / (tf + k (1 - b + b len / avg))).

    Without lengths, tf brings each document's `len` itself. Queries of at most HELD_BYTES are held by every task, and only
    postings of their terms go on, without a shuffle.
    """
    size = queries.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    held = F.broadcast if size <= HELD_BYTES else lambda x: x
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = df.join(held(wanted.select("term").distinct()), "term", "left_semi")
    known = held(wanted.join(held(asked), "term").select("query_id", "term", idf.alias("idf")))
    share = 1 - p.b + p.b * F.col("len") / F.lit(avg_len)
    part = F.col("idf") * (p.d + F.col("tf") * (p.k + 1) / (F.col("tf") + p.k * share))
    found = tf.join(known, "term")
    return (found if lengths is None else found.join(lengths, "doc")).groupBy("query_id", "doc").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc") -> DataFrame:
    """The k best of each query with their 1-based rank (the window is filtered by rank, so each task sends k rows a query)."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def cosine_scores(queries: DataFrame, rows: DataFrame, vec: str = "embedding", key: str = "doc", best: int | None = None, floor: float | None = None, slack: float = 1e-6, held_bytes: int = HELD_BYTES, block: int = BLOCK) -> DataFrame:
    """(query_id, doc, score): dot products of a given set of queries (query_id, vector) with all rows, in blocks.

    With `best`, each block leaves out what can't be among a query's best: scores of more than `slack` below the best-th of
    the block; top_k takes the rest. With `floor`, scores of more than `slack` below it are left out. Queries of at most held_bytes are held by every task, and rows are not shuffled;
    more of them are cut into blocks, as rows are, and each pair of blocks is one cell, dealt out over tasks. Null and
    empty vectors, and pairs of different lengths, have no score.
    """
    spark = rows.sparkSession
    some = lambda c: c.isNotNull() & (F.size(c) > 0)
    q = queries.select("query_id", as_given(queries, "vector").alias("vec")).filter(some(F.col("vec")))
    x = rows.select(F.col(key).alias("doc"), as_given(rows, vec).alias("vec")).filter(some(F.col("vec")))
    kinds = q.schema["query_id"].dataType.simpleString(), x.schema["doc"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, doc {kinds[1]}, score double"

    def scores(ids: pa.Array, known: np.ndarray, docs: pa.Array, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(values), 4096):
            for at in range(0, len(known), 256):
                dots = known[at : at + 256] @ values[lo : lo + 4096].T
                least = np.full(len(dots), -np.inf)
                if best is not None and dots.shape[1] > best:
                    least = np.partition(dots, -best, axis=1)[:, -best] - slack
                if floor is not None:
                    least = np.maximum(least, floor - slack)
                i, j = np.nonzero(dots >= least[:, None])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + i)), docs.take(pa.array(lo + j)), pa.array(dots[i, j])], ["query_id", "doc", "score"])

    size = q.agg(F.sum(F.size("vec").cast("long")).alias("numbers"), F.count("*").alias("rows")).first()
    if 8 * (size["numbers"] or 0) <= held_bytes:
        t = q.toArrow().combine_chunks()  # at most held_bytes of vectors
        length = pc.list_value_length(t["vec"]).to_numpy()
        groups = {int(d): t.filter(pa.array(length == d)).combine_chunks() for d in np.unique(length)}
        held = spark.sparkContext.broadcast({d: (g["query_id"].combine_chunks(), matrix(g["vec"].combine_chunks())) for d, g in groups.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                length = pc.list_value_length(batch.column(1)).to_numpy()
                for d, (ids, known) in held.value.items():
                    same = batch.filter(pa.array(length == d))
                    if same.num_rows:
                        yield from scores(ids, known, same.column(0), matrix(same.column(1)))

        return x.mapInArrow(run, schema)

    many = x.count()
    dims = -(-size["numbers"] // size["rows"])
    n, m = -(-size["rows"] // block_rows(size["rows"], dims, block)), -(-many // block_rows(many, dims, block))
    d, own = F.size("vec").alias("d"), lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).alias("own")
    other = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias("other")
    if not m:
        return spark.createDataFrame([], schema)
    if q.schema["vec"].dataType != x.schema["vec"].dataType:
        q, x = (t.withColumn("vec", F.col("vec").cast("array<double>")) for t in (q, x))
    left = q.select(d, own("query_id", n), other(m), "query_id", "vec").select("d", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "query_id", F.lit(None).cast(kinds[1]).alias("doc"), "vec")
    right = x.select(d, own("doc", m), other(n), "doc", "vec").select("d", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("query_id"), "doc", "vec")
    dealt = left.unionByName(right).repartition("d", "i", "j").sortWithinPartitions("d", "i", "j")

    def product(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        side = t["side"].to_numpy()
        asks, holds = (t.filter(pa.array(side == k)).combine_chunks() for k in (0, 1))
        if asks.num_rows and holds.num_rows:
            yield from scores(asks["query_id"].combine_chunks(), matrix(asks["vec"].combine_chunks()), holds["doc"].combine_chunks(), matrix(holds["vec"].combine_chunks()))

    return dealt.mapInArrow(lambda batches: by_cell(batches, 3, product), schema)


def fuse(first: DataFrame, second: DataFrame, c: int = 60) -> DataFrame:
    """(query_id, doc, score): reciprocal rank fusion of two rankings (query_id, doc, rank)."""
    a, b = first.select("query_id", "doc", F.col("rank").alias("_a")), second.select("query_id", "doc", F.col("rank").alias("_b"))
    part = lambda r: F.coalesce(1.0 / (c + F.col(r)), F.lit(0.0))
    return a.join(b, ["query_id", "doc"], "full").select("query_id", "doc", (part("_a") + part("_b")).alias("score"))


def z_score(score: Column, mean: float, std: float) -> Column:
    return (score - mean) / std if std else F.lit(0.0)


def with_parents(found: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Small to big: found (doc, ...) with the text and heading of each child's parent."""
    return found.join(children.select("doc", "pid"), "doc").join(parents.select("pid", F.col("t").alias("parent_t"), F.col("x").alias("parent_x"), "u"), "pid")
