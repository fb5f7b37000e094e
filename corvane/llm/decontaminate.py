"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) word sequences. From every `span - k + 1` consecutive k-grams the one of least hash is kept
as a fingerprint, on both sides by the same rule, so two texts that share `span` words share a fingerprint. Fingerprints
of documents are joined with those of benchmark items. A hit is extended to the windows of `span` words around it: each
window that holds the fingerprint is looked up among the items' windows, once for each distinct one, and its words are
compared. So a word that repeats a million times costs a lookup for each of its places, not for each pair of places. An
item of fewer words is one window of its own length, found by the hash of its whole sequence and compared likewise.

The benchmark is broadcast in blocks of at most `block_bytes` of text (a longer text is a block of its own), held as
arrays of about six times that. One block (the usual case) needs no shuffle at all; more blocks run one after the other
over distinct texts, which are written once, and their hits, rows of documents that have any, meet in one aggregation.

Defined cases: null texts have no words; items without words are no windows; equal items are each reported; equal
documents are each judged; empty tables give no rows or no hits; null item ids are left out of the lists but their words
count as hit; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import stage

SPAN, GRAM = 10, 6
BLOCK_BYTES = 16 << 20


_SEPARATED = bytes(int(B.LOWER[b]) if B.ALNUM[b] else 0x20 for b in range(256))


class Windows:
    """The distinct windows of one length of the items: hash, one place, and the items that have it."""

    def __init__(self, size: int, hashes: np.ndarray, at: np.ndarray, item: np.ndarray):
        self.size = size
        self.hashes, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        self.at = at[first]
        both = np.unique(np.stack([code, item], 1), axis=0) if len(code) else np.zeros((0, 2), np.int64)
        self.bounds, self.items = np.searchsorted(both[:, 0], np.arange(len(self.hashes) + 1)), both[:, 1].astype(np.int32)


class Index:
    """Fingerprints and windows of a block of items, scanned as documents are."""

    def __init__(self, items: list[tuple[str | None, str | None]], span: int = SPAN, k: int = GRAM):
        if not 0 < k <= span:
            raise ValueError("k must be 1 to span")
        self.span, self.k = span, k
        same: dict[bytes, list[str]] = {}
        for name, text in items:
            if words := (text or "").encode().translate(_SEPARATED).split():
                held = same.setdefault(b" ".join(words), [])
                if name is not None:
                    held.append(name)
        self.names = list(same.values())
        texts = pa.array(list(same), pa.large_binary())
        self.data = b"".join(same)
        starts, ends, prints, windows, base, done = [], [], [], {}, 0, 0
        for lo, hi in B.slices(texts):
            buf, offs = B.raw(texts.slice(lo, hi - lo))
            s, e, first = B.word_spans(buf, offs, B.ALNUM)
            h, n = B.span_hashes(buf, s, e), np.diff(first)
            g, w = B.grams(h, k), span - k + 1
            if len(g) >= w:
                p = B.winnow(g, w)
                prints.append(np.unique(g[p[B.in_document(first, span, len(p))]]))
                at = np.flatnonzero(B.in_document(first, span, len(g) - w + 1))
                windows.setdefault(span, []).append((B.grams(h, span)[at], at + done, lo + np.searchsorted(first, at, "right") - 1))
            for m in np.unique(n[n < span]).tolist():
                of = np.flatnonzero(n == m)
                windows.setdefault(m, []).append((B.grams(h, m)[first[of]], first[of] + done, of + lo))
            starts.append(s + base)
            ends.append(e + base)
            base, done = base + len(buf), done + len(s)
        kind = np.int32 if base < 1 << 31 else np.int64
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.starts, self.ends = join(starts, kind), join(ends, kind)
        self.prints = np.unique(join(prints, B.U64))
        self.windows = {m: Windows(m, *(join(x, t) for x, t in zip(zip(*found, strict=True), (B.U64, np.int64, np.int64), strict=True))) for m, found in windows.items()}

    def words(self, at: int, n: int) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True)]


def scan(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, list[tuple[int, int]], list[int]]]:
    """(row, words, merged spans of hit words, items) of each text."""
    w = index.span - index.k + 1
    for lo, hi in B.slices(texts):
        buf, offs = B.raw(texts.slice(lo, hi - lo))
        buf = B.LOWER[buf]
        starts, ends, first = B.word_spans(buf, offs, B.ALNUM)
        h, sizes = B.span_hashes(buf, starts, ends), np.diff(first)
        doc = np.repeat(np.arange(hi - lo), sizes)
        begins, stops, pairs = [], [], []

        def met(at: np.ndarray, hashes: np.ndarray, of: Windows) -> None:
            """Windows of the documents at some places, if the items have them."""
            code = np.searchsorted(of.hashes, hashes)
            ok = np.flatnonzero(code < len(of.hashes))
            ok = ok[of.hashes[code[ok]] == hashes[ok]]
            at, code = at[ok], code[ok]
            if not len(at):
                return
            known, one, each = np.unique(code, return_index=True, return_inverse=True)
            place = at[one]  # of each distinct window one is compared by its words, the others with that one
            same = np.array([[buf[starts[p + j] : ends[p + j]].tobytes() for j in range(of.size)] == index.words(int(of.at[c]), of.size) for p, c in zip(place.tolist(), known.tolist(), strict=True)])[each]
            for j in range(of.size):
                same &= h[at + j] == h[place[each] + j]
            at, code = at[same], code[same]
            begins.append(at)
            stops.append(at + of.size)
            both = np.unique(doc[at].astype(np.int64) * len(of.hashes) + code)  # a document and a window once
            d, code = both // len(of.hashes), both % len(of.hashes)
            n = of.bounds[code + 1] - of.bounds[code]
            upto = np.cumsum(n)
            where = np.arange(int(upto[-1]) if len(n) else 0) + np.repeat(of.bounds[code] - (upto - n), n)
            pairs.append(np.unique(np.stack([np.repeat(d, n), of.items[where]], 1), axis=0))

        for size, windows in index.windows.items():
            if size < index.span:
                g = B.grams(h, size)
                at = np.flatnonzero(B.in_document(first, size, len(g)))
                met(at, g[at], windows)
            elif len(h) >= size:
                g = B.grams(h, index.k)
                p = B.winnow(g, w)
                p = np.unique(p[B.in_document(first, size, len(p))])
                p = p[np.isin(g[p], index.prints)]
                around = np.zeros(len(h) + 1, np.int64)  # each window that holds the fingerprint begins up to w - 1 words before it
                np.add.at(around, np.maximum(p - w + 1, 0), 1)
                np.add.at(around, p + 1, -1)
                at = np.flatnonzero(np.cumsum(around[:-1]) > 0)
                at = at[doc[at] == doc[np.minimum(at + size - 1, len(h) - 1)]]
                at = at[at + size <= len(h)]
                met(at, B.grams(h, size)[at], windows)
        if begins:
            hit = B.covered(len(h), np.concatenate(begins), np.concatenate(stops))
            found = np.unique(np.concatenate(pairs), axis=0)
            begin, stop = B.stretches(hit, first)
            by, item = np.searchsorted(begin, first), np.searchsorted(found[:, 0], np.arange(hi - lo + 1))
        for d in range(hi - lo):
            if begins:
                a, b = by[d], by[d + 1]
                spans = list(zip((begin[a:b] - first[d]).tolist(), (stop[a:b] - first[d]).tolist(), strict=True))
                yield lo + d, int(sizes[d]), spans, found[item[d] : item[d + 1], 1].tolist()
            else:
                yield lo + d, int(sizes[d]), [], []


_SPANS = "array<struct<start:bigint,stop:bigint>>"


def _block_of(n: int):
    return F.pmod(F.xxhash64("text"), F.lit(n))


def _blocks(items: DataFrame, block_bytes: int) -> int:
    """How many blocks leave none above block_bytes but those of a single text (equal texts are one)."""
    texts = items.select("text", F.octet_length("text").cast("long").alias("size")).dropDuplicates(["text"])
    total, count = texts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = max(1, -(-total // block_bytes))
    while n > 1 and n < count and texts.groupBy(_block_of(n).alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("texts")).filter((F.col("size") > block_bytes) & (F.col("texts") > 1)).limit(1).count():
        n *= 2
    return n


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = GRAM, block_bytes: int = BLOCK_BYTES, keep_columns: bool = False) -> DataFrame:
    """Each document with _words, _spans (merged hit spans, in words) and _items (ids of items found, as sorted strings); keep_columns keeps all columns of docs, else only id_col."""
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    n = _blocks(items, block_bytes)
    block = lambda b: Index([tuple(r) for r in items.filter(_block_of(n) == b).collect()], span, k)  # noqa: E731  of block_bytes, or one text
    carried = [c for c in docs.columns if c not in ("_words", "_spans", "_items")] if keep_columns else [id_col]
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)], F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"_c{i} {t}" for i, (_, t) in enumerate(rows.dtypes[:-1]))

    def matcher(index: Index, key_only: bool):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                at, words, spans, names = [], [], [], []
                for row, size, hits, items in scan(B.text_array(batch.column(batch.num_columns - 1)), index):
                    if key_only and not hits:
                        continue
                    at.append(row)
                    words.append(size)
                    spans.append([{"start": a, "stop": b} for a, b in hits])
                    names.append(sorted({x for i in items for x in index.names[i]}))
                kept = batch.take(pa.array(at, pa.int64())).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(names, pa.list_(pa.string()))], [*batch.schema.names[:-1], "_words", "_spans", "_items"])

        return run

    tail = f"_words long, _spans {_SPANS}, _items array<string>"
    if n == 1:
        out = rows.mapInArrow(matcher(block(0), False), f"{kinds}, {tail}")
    else:
        key = F.unhex(F.md5(F.col("_text").cast("binary"))).alias("_h")  # 128 bits name a text across the corpus
        keyed = stage(rows.select(key, "_text").dropDuplicates(["_h"]), "texts")  # read once for each block
        found = None
        for b in range(n):
            part = stage(keyed.mapInArrow(matcher(block(b), True), f"_h binary, {tail}"), "hits")
            found = part if found is None else found.unionByName(part)
        merged = found.groupBy("_h").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
        out = rows.withColumn("_h", key).join(merged, "_h", "left")
        out = out.select(*[f"_c{i}" for i in range(len(carried))], count_words(F.col("_text")).alias("_words"), merge_spans(F.coalesce("_spans", F.expr(f"cast(array() as {_SPANS})"))).alias("_spans"), F.coalesce("_items", F.expr("cast(array() as array<string>)")).alias("_items"))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)], "_words", "_spans", "_items")


def count_words(text):
    return F.coalesce(F.size(F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")), F.lit(0)).cast("long")


def merge_spans(spans):
    """Overlapping or touching spans of the sorted list joined."""
    empty = F.expr(f"cast(array() as {_SPANS})")

    def one(out, s):
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(out) > 0) & (s["start"] <= last["stop"]), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, one)
