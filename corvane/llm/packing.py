"""Packing token sequences by best-fit decreasing.

A document's ids (an end id after its own) are first cut into full windows; the rest, and every short document, is a
piece. Pieces are taken by falling length, each into the open window with the least room that still holds it; a segment
tree over remaining capacity finds that window in log(window) steps. Every task packs the pieces of its own rows in
groups of bounded size, so nothing is shuffled but one row per task, which numbers the sequences globally.

Defined cases: null text is an empty text (one piece, the end id); null or repeated ids are carried as they are, every
row being a document of its own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import stage
from .tokens import Encoder

#: Pieces that one round of best-fit decreasing takes at once; bounds a task's memory.
GROUP = 1 << 17


class RoomTree:
    """Open windows by remaining capacity; leaf c counts windows with room for exactly c more ids."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.held: dict[int, list[int]] = {}

    def put(self, window: int, room: int) -> None:
        self.held.setdefault(room, []).append(window)
        node = self.base + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (window, room) with the least room >= need; None if there is none."""
        count, node = self.count, self.base + need
        while not count[node]:
            while node & 1:  # a right child: go up until there is a right neighbour
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.base:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.base
        while node:
            count[node] -= 1
            node >>= 1
        return self.held[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window number, offset) of each length in 1..window, and the number of windows."""
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = RoomTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        got = tree.take(need)
        if got is None:
            got, n = (n, window), n + 1
        seq[i], off[i] = got[0], window - got[1]
        if got[1] > need:
            tree.put(got[0], got[1] - need)
    return seq, off, n


def _cut(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of each piece."""
    n = -(-sizes // window)
    doc = np.repeat(np.arange(len(sizes)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
    return doc, start, np.minimum(window, sizes[doc] - start)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds its ids (32-bit little-endian) as `ids`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _part int, _seq long, offset long" + ", ids binary" * with_ids

    def flush(held: list, first: int) -> tuple[pa.RecordBatch, int]:
        ids = pa.concat_arrays([h[0] for h in held])
        start, length, crc, total = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        full = length == window
        n = int(full.sum())
        seq[full] = np.arange(n)
        part_seq, off[~full], more = best_fit_decreasing(length[~full], window)
        seq[~full] = part_seq + n
        cols = [ids, start, length, crc, total, np.full(len(seq), TaskContext.get().partitionId(), np.int32), seq + first, off]
        names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_seq", "offset"]
        if with_ids:
            cols, names = [*cols, pa.array([b for h in held for b in h[5]], pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names), first + n + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, waiting, first = Encoder.get(tokenizer), [], 0, 0
        for batch in batches:
            text, ids = B.text_array(batch.column(1)), batch.column(0)
            for lo, hi in B.slices(text, 1 << 22):
                flat, offs = encoder.with_end(text.slice(lo, hi - lo), end_id)
                sizes = np.diff(offs)
                doc, start, length = _cut(sizes, window)
                at, view = (4 * (offs[doc] + start)).tolist(), memoryview(flat.tobytes())
                cut = [view[a : a + 4 * n] for a, n in zip(at, length.tolist(), strict=True)]
                crc = np.fromiter(map(zlib.crc32, cut), np.int64, len(cut))
                held.append((ids.slice(lo, hi - lo).take(pa.array(doc)), start, length, crc, sizes[doc], [bytes(c) for c in cut] if with_ids else None))
                waiting += len(doc)
                if waiting >= (GROUP // 32 if with_ids else GROUP):
                    out, first = flush(held, first)
                    held, waiting = [], 0
                    yield out
        if held:
            yield flush(held, first)[0]

    local = stage(rows.mapInArrow(run, schema), "pack")
    counts = sorted((r["_part"], r["n"]) for r in local.groupBy("_part").agg((F.max("_seq") + 1).alias("n")).collect())
    base = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, base, strict=False)], "_part int, _base long")  # one row per task
    out = local.join(F.broadcast(offsets), "_part")
    return out.select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("_seq")).alias("sequence_id"), "offset", *["ids"] * with_ids)
