"""BM25 postings in blocks with block maxima, and exact search that skips blocks.

`blocks` writes a term's postings as rows of at most `size` documents of one shard (a range of document numbers): numbers
as differences and frequencies, both in bytes of seven bits, with the first and last document and the greatest BM25 part
of the block. Documents, not their postings, are dealt out by ranges of their numbers; a task takes them in order and cuts
blocks of HELD_TERMS terms' worth of them at a time, so no term, however frequent, is in one row or task.

`search` gives each shard's blocks of the queries' terms to one task, which takes a query's terms from the greatest bound
(idf * greatest part) down. As long as what is left could lift an unseen document among the best k, a term's blocks are
all read. From then on only documents that can still get there are followed: a block is read if it holds one of them in
its range and its own maximum could matter, others are skipped. Of each shard the k best of each query leave the task.

Documents are numbered by integers; rows without a number are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schemas import Bm25

#: Postings of a block, and documents of a shard (a power of two).
BLOCK_DOCS, SHARD_BITS = 128, 16
#: Terms, with repeats, of the documents that a task makes blocks of at a time.
HELD_TERMS = 1 << 21
#: Query text that a task may hold.
HELD_BYTES = 32 << 20
#: Scores are compared after rounding to six digits; nothing within that is pruned.
SLACK = 2e-6


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, seven bits a byte from the lowest on; a set top bit says that more follows."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        have = size > k
        part = (v[have] >> np.uint64(7 * k)) & np.uint64(127)
        out[(end - size)[have] + k] = part.astype(np.uint8) | np.where(size[have] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begin)


def packed(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """pack() of each stretch of values, which start at begin (0 first), at once."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= 1 << 7 * k
    offsets = np.append(0, np.cumsum(sizes))[np.append(begin, len(values))]
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(pack(values))])


def blocks(terms: DataFrame, avg_len: float, p: Bm25 = Bm25(), size: int = BLOCK_DOCS, shard_bits: int = SHARD_BITS, held: int = HELD_TERMS) -> DataFrame:
    """(shard, term, first, last, n, top, docs, tfs, lens) from (doc, terms): a block of postings each; top is the greatest BM25 part without idf, lens are lengths of documents. Rows of one doc are one document."""
    rows = terms.filter("doc is not null AND size(terms) > 0").select(F.col("doc").cast("bigint").alias("doc"), F.size("terms").alias("n"), F.array_join("terms", " ").alias("text"))
    names = ["shard", "term", "first", "last", "n", "top", "docs", "tfs", "lens"]

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The blocks of documents of one shard, in ascending order."""
        t = pa.Table.from_batches(parts).combine_chunks()
        doc, n = t.column(0).to_numpy(), t.column(1).to_numpy().astype(np.int64)
        here, at = np.unique(doc, return_inverse=True)
        length = np.bincount(at, n).astype(np.int64)
        word = pc.split_pattern(t.column(2).combine_chunks(), " ").flatten().dictionary_encode()
        key = np.sort(word.indices.to_numpy().astype(np.int64) * len(here) + np.repeat(at, n))
        run = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf, code, at = np.diff(np.append(run, len(key))), key[run] // len(here), key[run] % len(here)
        doc, length = here[at], length[at]
        group = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        place = np.arange(len(doc)) - np.repeat(group, np.diff(np.append(group, len(doc))))
        begin = np.flatnonzero(place % size == 0)
        end = np.append(begin[1:], len(doc))
        part = p.d + tf * (p.k + 1) / (tf + p.k * (1 - p.b + p.b * length / avg_len))
        gap = np.diff(doc, prepend=doc[0])
        gap[begin] = 0
        cols = [
            pa.array(doc[begin] >> shard_bits), word.dictionary.take(pa.array(code[begin])), pa.array(doc[begin]), pa.array(doc[end - 1]), pa.array(end - begin), pa.array(np.maximum.reduceat(part, begin)),
            packed(gap, begin), packed(tf, begin), packed(length, begin),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total, last = [], 0, None
        for batch in batches:
            start = 0
            for i, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if last is not None and doc != last and (total >= held or doc >> shard_bits != last >> shard_bits):
                    yield made([*parts, batch.slice(start, i - start)])
                    parts, total, start = [], 0, i
                total, last = total + n, doc
            parts.append(batch.slice(start))
        if total:
            yield made(parts)

    schema = "shard bigint, term string, first bigint, last bigint, n bigint, top double, docs binary, tfs binary, lens binary"
    return rows.repartitionByRange("doc").sortWithinPartitions("doc").mapInArrow(run, schema)


@dataclass
class _List:
    """A term's blocks in one shard."""

    first: np.ndarray
    last: np.ndarray
    n: np.ndarray
    top: np.ndarray
    data: list[tuple]
    read: dict[int, tuple[np.ndarray, np.ndarray]]

    def block(self, i: int, p: Bm25, avg: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents, parts) of a block."""
        if i not in self.read:
            docs, tfs, lens = (unpack(x.as_buffer()) for x in self.data[i])
            self.read[i] = self.first[i] + np.cumsum(docs), p.d + tfs * (p.k + 1) / (tfs + p.k * (1 - p.b + p.b * lens / avg))
        return self.read[i]


def best_of(lists: list[tuple[_List, float]], k: int, p: Bm25, avg: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, postings read) of the k best, ties by document, and whatever else rounds like them."""
    lists = sorted(lists, key=lambda x: -float(x[0].top.max()) * x[1])
    bound = [float(x.top.max()) * idf for x, idf in lists]
    left = np.cumsum([*bound, 0.0][::-1])[::-1]  # from each list on
    docs, score, read = np.zeros(0, np.int64), np.zeros(0), 0
    for i, (x, idf) in enumerate(lists):
        least = np.partition(score, -k)[-k] if len(score) >= k else -np.inf
        if left[i] >= least - SLACK:  # a document that no list has named yet may get there
            wanted = range(len(x.first))
        else:
            alive = score + left[i] >= least - SLACK
            docs, score = docs[alive], score[alive]
            at = np.clip(np.searchsorted(x.last, docs), 0, len(x.last) - 1)
            inside = (x.first[at] <= docs) & (docs <= x.last[at])
            may = inside & (score + x.top[at] * idf + left[i + 1] >= least - SLACK)
            out = inside & ~may  # with this block's maximum they can't
            wanted, keep = np.unique(at[may]).tolist(), ~out
            docs, score = docs[keep], score[keep]
        found = [x.block(b, p, avg) for b in wanted]
        read += int(sum(len(d) for d, _ in found))
        if found:
            d, part = np.concatenate([d for d, _ in found]), np.concatenate([s for _, s in found]) * idf
            at = np.searchsorted(docs, d)
            known = np.zeros(len(d), bool)
            inner = at < len(docs)
            known[inner] = docs[at[inner]] == d[inner]
            score[at[known]] += part[known]
            if left[i] >= least - SLACK:
                docs, score = np.concatenate([docs, d[~known]]), np.concatenate([score, part[~known]])
                order = np.argsort(docs)
                docs, score = docs[order], score[order]
    rounded = np.round(score, 6)
    best = np.lexsort((docs, -rounded))[: k + 8]  # the plan rounds by itself and takes k
    return docs[best], score[best], read


def search(index: DataFrame, queries: DataFrame, df: DataFrame, docs: int, avg_len: float, k: int = 10, p: Bm25 = Bm25(), report: bool = False) -> DataFrame:
    """(query_id, doc, score) of each shard's best for queries (query_id, text); report: instead (query_id, postings, read) of each shard."""
    spark = index.sparkSession
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms")).filter(F.size("terms") > 0)
    size = q.agg(F.coalesce(F.sum(F.length(F.concat_ws(" ", "terms"))), F.lit(0))).first()[0]
    if size > HELD_BYTES:
        raise ValueError("more query text than a task may hold: search in parts")
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = q.select(F.explode("terms").alias("term")).distinct()
    known = df.join(F.broadcast(known), "term", "left_semi").select("term", idf.alias("idf"))  # goes below the sum of df
    weight = {r["term"]: r["idf"] for r in known.collect()}  # a term of the queries each
    asked = [(r["query_id"], [t for t in r["terms"] if t in weight]) for r in q.collect()]
    kind = queries.schema["query_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast((asked, weight))
    wanted = spark.createDataFrame([(t,) for t in weight], "term string")
    rows = index.join(F.broadcast(wanted), "term", "left_semi").repartition("shard").sortWithinPartitions("shard", "term", "first")
    cols = ["shard", "term", "first", "last", "n", "top", "docs", "tfs", "lens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = held.value
        parts, last = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            term = t.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(term)) if term[i] != term[i - 1]), len(term)]
            number = [t.column(c).to_numpy() for c in range(2, 6)]
            data = list(zip(*(t.column(c) for c in (6, 7, 8)), strict=True))
            lists = {term[a]: _List(*(x[a:b] for x in number), data[a:b], {}) for a, b in zip(cuts, cuts[1:], strict=False)}
            out: list[tuple] = []
            for name, terms in asked:
                mine = [(lists[w], weight[w]) for w in terms if w in lists]
                if mine:
                    found, score, read = best_of(mine, k, p, avg_len)
                    out += [(name, int(sum(x.n.sum() for x, _ in mine)), read)] if report else zip([name] * len(found), found.tolist(), score.tolist(), strict=True)
            if out:
                names = ["query_id", "postings", "read"] if report else ["query_id", "doc", "score"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if parts and shard[a] != last:
                    yield from flush()
                    parts = []
                parts.append(batch.slice(a, b - a))
                last = shard[a]
        if parts:
            yield from flush()

    return rows.select(cols).mapInArrow(run, f"query_id {kind}, postings bigint, read bigint" if report else f"query_id {kind}, doc bigint, score double")
