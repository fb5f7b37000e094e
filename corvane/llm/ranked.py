"""Ranked lexical search over inverted treaps.

`build` turns documents into an index of blocks in the shared folder: each block holds the postings of all terms of some
megabytes of whole texts. `search` answers all queries over all blocks. A task joins its blocks to shards of bounded size,
makes a treap for each term that some query has (see treaps.py) and walks the treaps of each query together, so it emits
the k best of its shard at most. A sixteenth of the blocks (by hash) is searched first; the k-th score that a query has
there is a floor for all others, so they emit little and prune more. The best of all shards are ranked at the end.

Scores are whole numbers. With N documents that have a term, L terms in all, n of the document, df documents with the
term and tf occurrences in this one, a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), a document's
m = 100 - 50 + (50 * n * N) div L, and the score is the sum over the query's distinct terms of
w * ((10**9 * tf) div (1000 * tf + 20 * m)).

Queries are held by every task in blocks, dealt by hash, of half of `block_bytes` of text each on average, which run one
after the other. Terms are compared by 64-bit hashes.

Defined cases: null texts have no terms; a query without known terms has no rows; equal queries are each answered, equal
documents each ranked; null ids sort first; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import stage
from .treaps import Treaps

BLOCK_BYTES = 32 << 20
#: Text bytes of an index block, and postings of the queries' terms in a shard.
SLICE_BYTES, SHARD_POSTINGS = 1 << 22, 1 << 22
FIRST_SHARE = 16


def _hashed(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, first term of each text and one past the last)."""
    buf, offs = B.raw(text)
    buf = B.LOWER[buf]
    starts, ends, first = B.word_spans(buf, offs, B.ALNUM)
    return B.span_hashes(buf, starts, ends), first


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, staged: a block's ids and lengths, and packed postings: terms (u64, ascending), how many documents each has, documents and occurrences (u32)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = B.text_array(batch.column(1))
            for lo, hi in B.slices(text, SLICE_BYTES):
                h, first = _hashed(text.slice(lo, hi - lo))
                size = np.diff(first)
                terms, code = np.unique(h, return_inverse=True)
                cell, tf = np.unique(code.astype(np.int64) * (hi - lo) + np.repeat(np.arange(hi - lo), size), return_counts=True)
                n = np.bincount(cell // (hi - lo), minlength=len(terms))
                packed = [x.astype(t).tobytes() for x, t in ((terms, "<u8"), (n, "<u4"), (cell % (hi - lo), "<u4"), (tf, "<u4"))]
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
                sizes = pa.array([size.astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, sizes, *[pa.array([x], pa.binary()) for x in packed]], ["ids", "sizes", "terms", "df", "docs", "tf"])

    return stage(rows.mapInArrow(run, f"ids array<{kind}>, sizes array<int>, terms binary, df binary, docs binary, tf binary"), "treap-blocks")


def _numbers(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _found(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in wanted, places in terms) of the terms in both, each ascending."""
    at = np.searchsorted(terms, wanted)
    ok = np.flatnonzero(at < len(terms))
    ok = ok[terms[at[ok]] == wanted[ok]]
    return ok, at[ok]


def document_frequencies(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How many documents hold each of the wanted (ascending) term hashes; a row a term comes to the driver at most."""
    held = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for terms, df in zip(*batch.columns, strict=True):
                mine, at = _found(_numbers(terms, "<u8"), held.value)
                total[mine] += _numbers(df, "<u4")[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    out = np.zeros(len(wanted), np.int64)
    for r in index.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Queries:
    """Distinct terms of a block of query texts."""

    def __init__(self, keys: list[str], texts: list[str]):
        h, first = _hashed(B.text_array(pa.array(texts, pa.large_string())))
        self.keys = keys
        self.terms, code = np.unique(h, return_inverse=True)
        self.of = [np.unique(code[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _shards(kind: pa.DataType, wanted: np.ndarray, docs: int, total: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Treaps]]:
    """(ids in order, treaps of the wanted terms over them) of blocks that are joined until a shard is full."""
    ids, size, term, doc, tf, held, base = [], [], [], [], [], 0, 0

    def made() -> tuple[pa.Array, Treaps]:
        id_ = pa.concat_arrays(ids)
        order = pc.array_sort_indices(id_, null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        m = 100 - 50 + 50 * np.concatenate(size).astype(np.int64) * docs // max(total, 1)
        t, d, f = np.concatenate(term), np.concatenate(doc), np.concatenate(tf)
        impact = 1_000_000_000 * f // (1000 * f + 20 * m[d])
        d = place[d]
        by = np.argsort(t * len(order) + d)
        return id_.take(pa.array(order)), Treaps(t[by], d[by], impact[by], len(wanted), len(order))

    for batch in batches:
        for b in range(batch.num_rows):
            i, s, terms, df, at, f = (batch.column(c)[b] for c in range(6))
            mine, here = _found(_numbers(terms, "<u8"), wanted)
            n = _numbers(df, "<u4").astype(np.int64)
            begin = (np.cumsum(n) - n)[here]
            n = n[here]
            upto = np.cumsum(n)
            some = np.arange(int(upto[-1]) if len(n) else 0) + np.repeat(begin - (upto - n), n)
            ids.append(i.values.cast(kind))
            size.append(s.values.to_numpy())
            term.append(np.repeat(mine, n))
            doc.append(_numbers(at, "<u4")[some].astype(np.int64) + base)
            tf.append(_numbers(f, "<u4")[some].astype(np.int64))
            base, held = base + len(ids[-1]), held + len(some)
            if held >= SHARD_POSTINGS:
                yield made()
                ids, size, term, doc, tf, held, base = [], [], [], [], [], 0, 0
    if base:
        yield made()


def _ranked(blocks: DataFrame, queries: Queries, weight: np.ndarray, docs: int, total: int, k: int, floor: dict[str, int]) -> DataFrame:
    """(_key, _id, score) of each query's k best of each shard."""
    kind = dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]
    held = blocks.sparkSession.sparkContext.broadcast((queries, weight, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight, floor = held.value
        first = next(batches, None)
        if first is None:
            return
        of_id = first.schema.field(0).type.value_type

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for ids, treaps in _shards(of_id, queries.terms, docs, total, every()):
            keys, found, scores = [], [], []
            for key, terms in zip(queries.keys, queries.of, strict=True):
                terms = terms[weight[terms] > 0]
                d, s = treaps.search(terms, weight[terms], k, floor.get(key, 1))
                keys += [key] * len(d)
                found.append(d)
                scores.append(s)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], ["_key", "_id", "score"])

    return blocks.select("ids", "sizes", "terms", "df", "docs", "tf").mapInArrow(run, f"_key string, _id {kind}, score long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_key").orderBy(F.col("score").desc(), F.col("_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks_of(texts: DataFrame, block_bytes: int) -> list[int]:
    """Block numbers; text goes to block pmod(xxhash64(_key), how many)."""
    total = texts.agg(F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0))).first()[0]
    return list(range(max(1, -(-2 * total // block_bytes))))


def search(index: DataFrame, queries: DataFrame, k: int = 50, query_id: str = "item_id", query_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of each query: query_id, rank (from 1), _id, score."""
    n = index.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("l"), F.size(F.filter("sizes", lambda x: x > 0)).cast("long").alias("n"))
    docs, total = n.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    key = F.md5(F.col(query_text).cast("string").cast("binary"))
    texts = queries.select(key.alias("_key"), F.col(query_text).cast("string").alias("_text")).filter("_text is not null").dropDuplicates(["_key"])
    numbers, best = _blocks_of(texts, block_bytes), None
    for b in numbers:
        rows = texts.filter(F.pmod(F.xxhash64("_key"), F.lit(len(numbers))) == b).collect()  # about block_bytes / 2
        block = Queries([r["_key"] for r in rows], [r["_text"] for r in rows])
        df = document_frequencies(index, block.terms)
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
        early = F.pmod(F.xxhash64("terms"), F.lit(FIRST_SHARE)) == 0
        first = stage(_top(_ranked(index.filter(early), block, weight, docs, total, k, {}), k), "first-ranked")
        floor = {r["_key"]: r["score"] for r in first.filter(F.col("rank") == k).select("_key", "score").collect()}  # one a query of this block
        rest = _ranked(index.filter(~early), block, weight, docs, total, k, floor)
        part = stage(_top(first.drop("rank").unionByName(rest), k), "ranked")
        best = part if best is None else best.unionByName(part)
    items = queries.select(F.col(query_id).alias("_item"), key.alias("_key"))
    return items.join(best, "_key").select(F.col("_item").alias(query_id), "rank", "_id", "score")
