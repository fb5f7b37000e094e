"""Exact substring deduplication with FM-indexes over shards.

A window is `span` consecutive words of one document; a word goes if a window over it occurs again anywhere, in the same
document included. To hold each text only against what can match it, shards are made by content:

  1. Each window names its k-gram of least hash (its anchor). Neighbouring windows with one anchor make a segment, and
     equal windows have equal anchors, so what occurs twice lies in segments of one anchor. Anchors seen once are done.
  2. Equal segments are one text with a weight. Segments go to shards by anchor; each shard builds a compressed FM-index
     (wavelet matrix) of its texts and streams them through backward search: matching statistics of all texts in
     lock-step, reporting the intervals of `span` words or more whose weight is two or more.
  3. Intervals go back to every document that has the segment, and are merged there.

An anchor with more than `hot` different segments (a passage of very many contexts) would make a shard of its own size;
its windows are taken apart and each becomes a segment whose anchor is its whole content, so it too is spread by content.

Words are runs of non-blank bytes, unchanged, compared by 64-bit hashes; texts by xxhash64 beside their id.

Defined cases: null and empty texts have no words; equal rows repeat each other, so all their windows go; null ids are
an id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .fmindex import FMIndex
from .shared import stage


@dataclass(frozen=True)
class Settings:
    span: int = 35
    k: int = 8
    hot: int = 20_000
    shard_words: int = 1_500_000


_BASE = B.U64(0xD1342543DE82EF95)
_INVERSE = B.U64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n + 1, base, B.U64)
    p[0] = 1
    return np.cumprod(p, dtype=B.U64)


def sequence_digests(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words [lo, hi) each."""
    sums = np.zeros(len(h) + 1, B.U64)
    np.cumsum(h * _powers(_BASE, len(h))[: len(h)], out=sums[1:])
    return B.mix((sums[hi] - sums[lo]) * _powers(_INVERSE, len(h))[lo] + (hi - lo).astype(B.U64))


def segments(h: np.ndarray, first: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, anchor) of each segment; windows are numbered by their first word in the slice."""
    g = B.grams(h, s.k)
    p = B.winnow(g, s.span - s.k + 1)
    none = np.zeros(0, np.int64)
    if not len(p):
        return none, none, none, np.zeros(0, B.U64)
    at = np.flatnonzero(B.in_document(first, s.span, len(p)))
    if not len(at):
        return none, none, none, np.zeros(0, B.U64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
    new = np.ones(len(at), bool)
    new[1:] = (p[at][1:] != p[at][:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], at[begin], np.diff(np.append(begin, len(at))), g[p[at[begin]]]


def _grouped(batch: pa.RecordBatch, row: np.ndarray, anchor: np.ndarray, seg: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows (_id, _t, _anchor, _seg, _ats, _n): the places of a segment in a document together, however often a text repeats itself."""
    order = np.lexsort((at, seg, row))
    row, anchor, seg, at, n = (x[order] for x in (row, anchor, seg, at, n))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (seg[1:] != seg[:-1]) | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(new)
    ats = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)).astype(np.int32)), pa.array(at.astype(np.int32)))
    take = pa.array(row[begin])
    cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor[begin].view(np.int64)), pa.array(seg[begin].view(np.int64)), ats, pa.array(n[begin].astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, ["_id", "_t", "_anchor", "_seg", "_ats", "_n"])


def _segment(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = B.text_array(batch.column(2))
            for lo, hi in B.slices(text):
                buf, offs = B.raw(text.slice(lo, hi - lo))
                starts, ends, first = B.word_spans(buf, offs, B.NOT_BLANK)
                h = B.span_hashes(buf, starts, ends)
                doc, at, n, anchor = segments(h, first, s)
                if len(doc):
                    d = sequence_digests(h, at, at + n + s.span - 1)
                    yield _grouped(batch, doc + lo, anchor, d, at - first[doc], n)

    return run


def _hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = B.raw(text)
    starts, ends, first = B.word_spans(buf, offs, B.NOT_BLANK)
    return B.span_hashes(buf, starts, ends), first


def _apart(s: Settings):
    """Segments as (_id, _t, _text, _list of _ats, _n) to one segment for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lists = B.text_array(batch.column(2)), batch.column(3).to_pylist()
            for lo, hi in B.slices(text):
                h, first = _hashes(text.slice(lo, hi - lo))
                rows, at = [], []
                for d in range(hi - lo):
                    own = [a + j for x in lists[lo + d] for a in x["_ats"] for j in range(x["_n"])]
                    rows += [lo + d] * len(own)
                    at += [int(first[d]) + x for x in own]
                if rows:
                    pos, row = np.array(at, np.int64), np.array(rows)
                    key = sequence_digests(h, pos, pos + s.span)
                    yield _grouped(batch, row, key, key, pos - first[row - lo], np.ones(len(row), np.int64))

    return run


def _cut_out(s: Settings):
    """Texts with _list of (_anchor, _seg, _m, _at, _n) to rows of segments with their words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lists = B.text_array(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in B.slices(text):
                h, first = _hashes(text.slice(lo, hi - lo))
                some = [(x, int(first[d]) + x["_at"]) for d in range(hi - lo) for x in lists[lo + d]]
                words = pa.array([h[a : a + x["_n"] + s.span - 1].tobytes() for x, a in some], pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array([x[c] for x, _ in some], pa.int64()) for c in ("_anchor", "_seg", "_m")], words], ["_anchor", "_seg", "_m", "_words"])

    return run


def _search(s: Settings):
    """A shard's segments to (_anchor, _seg, _spans): its FM-index, and every segment streamed through it."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        words = [np.frombuffer(x.as_buffer(), B.U64) for x in t.column(3).combine_chunks()]
        found = FMIndex(words, t.column(2).to_numpy()).repeated(s.span)
        spans = pa.array([[{"a": a, "b": b} for a, b in x] for x in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        out = pa.table([t.column(0).combine_chunks(), t.column(1).combine_chunks(), spans], ["_anchor", "_seg", "_spans"])
        return out.filter(pa.array([bool(x) for x in found], pa.bool_())).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by anchor: a shard ends between two anchors, once it holds enough words.
        held, size, last = [], 0, None
        for batch in batches:
            key, n = batch.column(0).to_numpy(), np.array([len(x.as_buffer()) // 8 for x in batch.column(3)], np.int64)
            if not len(key):
                continue
            total, begin = np.cumsum(n), 0
            change = np.flatnonzero(np.concatenate([[last is not None and key[0] != last], key[1:] != key[:-1]]))
            for c in change.tolist():
                before = size + (total[c - 1] if c else 0) - (total[begin - 1] if begin else 0)
                if before >= s.shard_words:
                    if c > begin:
                        held.append(batch.slice(begin, c - begin))
                    if held:
                        yield from flush(held).to_batches()
                    held, size, begin = [], 0, c
            held.append(batch.slice(begin))
            size += int(total[-1] - (total[begin - 1] if begin else 0))
            last = int(key[-1])
        if held:
            yield from flush(held).to_batches()

    return run


def repeated_spans(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _t, _spans array<struct<a,b>>): word intervals that go, for each document (id, xxhash64 of text) that has any; they may overlap."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), text.alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    schema = f"_id {kind}, _t long, _anchor long, _seg long, _ats array<int>, _n int"
    every = stage(rows.mapInArrow(_segment(s), schema), "segments")

    def twice(df: DataFrame) -> DataFrame:
        # The counts are a table of their own, so that both sides of the join are plain exchanges and a hot anchor's rows can be split.
        common = stage(df.groupBy("_anchor").agg(F.sum(F.size("_ats")).alias("_c")).filter("_c > 1").select("_anchor"), "anchors")
        return df.join(common, "_anchor")

    some = stage(twice(every).select("_id", "_t", "_anchor", "_seg", "_ats", "_n"), "shared")
    texts = lambda some: some.groupBy("_anchor", "_seg").agg(F.sum(F.size("_ats")).alias("_m"), F.min(F.struct("_id", "_t", F.col("_ats")[0].alias("_at"), "_n")).alias("_r"))
    different = stage(texts(some), "different")
    hot = stage(different.groupBy("_anchor").agg(F.count("*").alias("_c")).filter(F.col("_c") > s.hot).select("_anchor"), "hot")
    if hot.limit(1).count():
        lists = some.join(hot, "_anchor").groupBy("_id", "_t").agg(F.collect_list(F.struct("_ats", "_n")).alias("_list"))  # within one document
        lists = lists.select(F.col("_id").alias("_wid"), F.col("_t").alias("_wt"), "_list")
        owners = rows.dropDuplicates(["_id", "_t"]).join(lists, rows["_id"].eqNullSafe(lists["_wid"]) & (rows["_t"] == lists["_wt"])).select("_id", "_t", "_text", "_list")
        apart = twice(stage(owners.mapInArrow(_apart(s), schema), "apart")).select(*some.columns)
        some = stage(some.join(hot, "_anchor", "left_anti").unionByName(apart), "shared")
        different = stage(texts(some), "different")
    lists = different.groupBy(F.col("_r._id").alias("_wid"), F.col("_r._t").alias("_wt")).agg(F.collect_list(F.struct("_anchor", "_seg", "_m", F.col("_r._at").alias("_at"), F.col("_r._n").alias("_n"))).alias("_list"))  # within one document
    owners = rows.join(lists, rows["_id"].eqNullSafe(lists["_wid"]) & (rows["_t"] == lists["_wt"])).select("_text", "_list")
    held = owners.mapInArrow(_cut_out(s), "_anchor long, _seg long, _m long, _words binary")
    shards = held.repartition("_anchor").dropDuplicates(["_anchor", "_seg"]).sortWithinPartitions("_anchor")
    found = stage(shards.mapInArrow(_search(s), "_anchor long, _seg long, _spans array<struct<a:int,b:int>>"), "found")
    moved = lambda at: F.transform("_spans", lambda x: F.struct((x["a"] + at).alias("a"), (x["b"] + at).alias("b")))
    hits = some.join(found, ["_anchor", "_seg"]).select("_id", "_t", F.flatten(F.transform("_ats", moved)).alias("_spans"))
    return stage(hits.groupBy("_id", "_t").agg(F.flatten(F.collect_list("_spans")).alias("_spans")), "spans")  # within one document


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [a, b), ascending and apart."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    return a[new], b[np.append(np.flatnonzero(new)[1:], len(a)) - 1] if len(a) else b


def remove_repeats(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 (of the kept words, joined by blanks), removed (merged word intervals) and, with_text, kept_text, for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_t"), text.alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    spans = repeated_spans(docs, s, id_col, text_col).select(F.col("_id").alias("_wid"), F.col("_t").alias("_wt"), "_spans")
    joined = rows.join(spans, rows["_id"].eqNullSafe(spans["_wid"]) & (rows["_t"] == spans["_wt"]), "left").select("_id", "_text", "_spans")
    interval = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, removed, texts = [], [], [], [], []
            for t, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                lo, hi = merged(*(spans.values.field(c).to_numpy() for c in ("a", "b"))) if spans.is_valid else ((), ())
                n, left, at = len(words), [], 0
                for a, b in zip(lo, hi, strict=True):
                    left += words[at:a]
                    at = b
                left = left + words[at:] if at else words
                kept = b" ".join(left)
                n_words.append(n)
                n_removed.append(n - len(left))
                digest.append(hashlib.sha256(kept).hexdigest())
                removed.append([{"a": int(a), "b": int(b)} for a, b in zip(lo, hi, strict=True)])
                texts.append(kept)
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), pa.array(removed, interval)]
            names = ["_id", "n_words", "n_removed", "kept_sha256", "removed"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = joined.mapInArrow(run, f"_id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<a:int,b:int>>" + ", kept_text string" * with_text)
    return out.withColumnRenamed("_id", id_col)
