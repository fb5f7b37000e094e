"""Token-id files: raw id payloads in ascending document order, each with a minimal perfect hash index.

One file holds one shard (little-endian throughout):

    bytes 0-7    b"CVIDS\\x00\\x01\\x00"
    bytes 8-11   length of the header, unsigned 32 bits
    header       JSON: part, shard, base (ids of the same part before this shard), docs, ids, width, end, least, greatest
                 (of its keys, null without any), levels, keys, at
    sections     at header.at[name], from the end of the header on, each on a multiple of 8:
                 key i64[docs]; valid u8[docs]; offset u64[docs+1]; words u64 (hash levels);
                 print u32[keys] and ordinal u32[keys] by slot; ids u16 or u32 [ids]

The folder `_directory` beside them, written by the first lookup, holds (file, docs, least, greatest) of each shard: `lookup` opens only files
whose range holds a key, one for a key unless its copies run on into the next shard.

What follows the last section is not part of the file's data. Spark's own writer makes the files (one row, one file), so
any store that Spark can write is good, and a lost task's half-written files are never committed. A key lookup is a
slot from the hash levels, a fingerprint to compare, an ordinal, an offset: constant time. Rows that share a key lie next
to each other; a lookup returns them all. Rows without a key (null) are only read in order.

Parts follow each other in order of document id (nulls first; equal ids by a hash of the text), so the concatenation of
all shards by (part, shard) is the whole corpus in ascending order. Null text is an empty text.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from . import mphf
from .tokens import Encoder

MAGIC = b"CVIDS\x00\x01\x00"
#: Ids after which a shard is closed; one longer document makes a longer shard.
SHARD_IDS = 1 << 22


def encode_shard(part: int, shard: int, base: int, keys: np.ndarray, valid: np.ndarray, offsets: np.ndarray, ids: np.ndarray, width: int, end: int) -> bytes:
    known = np.flatnonzero(valid)
    distinct, first = np.unique(keys[known], return_index=True)
    hashed = distinct.astype(np.int64).view(B.U64)
    levels, words = mphf.build(hashed)
    slot = mphf.slots(hashed, levels, words, mphf.ranks(words))
    print_, ordinal = np.zeros(len(slot), "<u4"), np.zeros(len(slot), "<u4")
    print_[slot], ordinal[slot] = mphf.fingerprint(hashed), known[first]
    sections = {"key": keys.astype("<i8"), "valid": valid.astype(np.uint8), "offset": offsets.astype("<u8"), "words": words.astype("<u8"), "print": print_, "ordinal": ordinal, "ids": ids.astype("<u2" if width == 2 else "<u4")}
    at, body, here = {}, [], 0
    for name, a in sections.items():
        data = a.tobytes()
        at[name] = [here, len(data)]
        body.append(data + b"\0" * (-len(data) % 8))
        here += len(body[-1])
    header = json.dumps({"part": part, "shard": shard, "base": base, "docs": len(keys), "ids": len(ids), "width": width, "end": end, "least": int(distinct[0]) if len(distinct) else None, "greatest": int(distinct[-1]) if len(distinct) else None, "levels": levels, "keys": len(slot), "at": at}).encode()
    header += b" " * (-(len(header) + 12) % 8)
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *body])


class Shard:
    """A shard file in memory."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        size = int.from_bytes(data[8:12], "little")
        self.header = json.loads(data[12 : 12 + size])
        kinds = {"key": "<i8", "valid": "u1", "offset": "<u8", "words": "<u8", "print": "<u4", "ordinal": "<u4", "ids": f"<u{self.header['width']}"}
        for name, kind in kinds.items():
            lo, n = self.header["at"][name]
            setattr(self, name, np.frombuffer(data, kind, n // np.dtype(kind).itemsize, 12 + size + lo))
        self.before = mphf.ranks(self.words)

    def ordinals(self, keys: np.ndarray) -> np.ndarray:
        """First document of each key, -1 where the shard has none (but for a false fingerprint, 2**-32, told by `key`)."""
        hashed = np.asarray(keys, np.int64).view(B.U64)
        slot = mphf.slots(hashed, self.header["levels"], self.words, self.before)
        out = np.full(len(slot), -1, np.int64)
        ok = slot >= 0
        ok[ok] = self.print[slot[ok]] == mphf.fingerprint(hashed[ok])
        out[ok] = self.ordinal[slot[ok]]
        return out

    def document(self, i: int) -> np.ndarray:
        return self.ids[int(self.offset[i]) : int(self.offset[i + 1])]

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every document with this key."""
        return self.copies(key, int(self.ordinals(np.array([key]))[0]))

    def copies(self, key: int, i: int) -> list[np.ndarray]:
        """Ids of the documents with this key, from the i-th on."""
        out = []
        while 0 <= i < len(self.key) and self.valid[i] and self.key[i] == key:
            out.append(self.document(i))
            i += 1
        return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shard files of docs (an integer id_col) under path."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.get(tokenizer), TaskContext.get().partitionId()
        width = 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4
        state = {"shard": 0, "base": 0, "n": 0}
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            key, valid, size, ids = (np.concatenate([h[k] for h in held]) for k in range(4))
            data = encode_shard(part, state["shard"], state["base"], key, valid, np.concatenate([[0], np.cumsum(size)]), ids, width, end_id)
            state.update(shard=state["shard"] + 1, base=state["base"] + len(ids), n=0)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["file"])

        for batch in batches:
            text, key = B.text_array(batch.column(1)), batch.column(0)
            for lo, hi in B.slices(text, 1 << 22):
                flat, offs = encoder.with_end(text.slice(lo, hi - lo), end_id)
                some = key.slice(lo, hi - lo)
                held.append((some.fill_null(0).to_numpy(zero_copy_only=False), np.array(some.is_valid()), np.diff(offs), flat.astype("<u2" if width == 2 else "<u4")))
                state["n"] += len(flat)
                if state["n"] >= SHARD_IDS:
                    yield close()
        if held:
            yield close()

    files = rows.mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """The directory's rows, from the files' headers; without Python."""
    size = F.conv(F.concat(*[F.hex(F.substring("content", i, 1)) for i in (12, 11, 10, 9)]), 16, 10).cast("int")
    shards = _binary(spark, path).filter(F.length("content") > 12)
    head = F.from_json(F.substring(F.col("content"), F.lit(13), size).cast("string"), "docs long, least long, greatest long")
    return shards.select(F.col("path").alias("file"), head.alias("_h")).select("file", "_h.*")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(file, docs, least, greatest) of each shard file under path; written at the first call, each task reading its share of the files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_directory/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        _headers(spark, path).write.mode("overwrite").parquet(f"{path}/_directory")
    return spark.read.schema("file string, docs long, least long, greatest long").parquet(f"{path}/_directory")


def _binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document with one of these keys, ids as little-endian unsigned 32-bit integers."""
    wanted = np.unique(np.array(keys, np.int64))
    within = F.exists(F.array(*[F.lit(k) for k in wanted.tolist()]).cast("array<bigint>"), lambda k: k.between(F.col("least"), F.col("greatest")))
    found = [r["file"] for r in directory(spark, path).filter(within).select("file").collect()]  # about one file a key
    schema = "doc_id long, n_tokens long, ids binary"
    if not found:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                s = Shard(data.as_buffer().to_pybytes())
                rows = [(k, ids) for k, i in zip(wanted.tolist(), s.ordinals(wanted).tolist(), strict=True) if i >= 0 for ids in s.copies(k, i)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([len(x) for _, x in rows], pa.int64()), pa.array([x.astype("<u4").tobytes() for _, x in rows], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return _binary(spark, found).select("content").mapInArrow(run, schema)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The shard files as rows, a `content` each."""
    return _binary(spark, path).select("content")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files, by key lookup: doc_id, _part, _start (ids of the part before it), n_tokens, ids_crc32, and with_ids its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                s = Shard(data.as_buffer().to_pybytes() if hasattr(data, "as_buffer") else data.as_py())
                n = s.header["docs"]
                keyed = np.flatnonzero(s.valid)
                first = s.ordinals(s.key[keyed])
                if (s.key[first] != s.key[keyed]).any():
                    raise ValueError("the index doesn't match its keys")
                at = np.arange(n)
                at[keyed] = _copies(first)
                offs = s.offset.astype(np.int64)
                wide = memoryview(s.ids.astype("<u4").tobytes())
                lo, hi = offs[at], offs[at + 1]
                cut = [wide[4 * a : 4 * b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                cols = [pa.array(s.key[at], mask=s.valid[at] == 0), pa.array(np.full(n, s.header["part"], np.int32)), pa.array(lo + s.header["base"]), pa.array(hi - lo), pa.array(np.fromiter(map(zlib.crc32, cut), np.int64, n))]
                names = ["doc_id", "_part", "_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([bytes(c) for c in cut], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return files(spark, path).mapInArrow(run, "doc_id long, _part int, _start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _copies(first: np.ndarray) -> np.ndarray:
    """first, in runs of equal ordinals, counted up within each run: the copies of a key lie next to each other."""
    run = np.concatenate([[0], np.cumsum(first[1:] != first[:-1])]) if len(first) else first
    begin = np.searchsorted(run, run, "left") if len(first) else first
    return first + np.arange(len(first)) - begin


def starts(rows: DataFrame) -> DataFrame:
    """Global `start` instead of _part and _start of read()'s rows."""
    parts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.sum("n_tokens").alias("n")).collect())  # one row per part
    before = np.cumsum([0, *(n for _, n in parts)]).tolist()
    base = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(parts, before, strict=False)], "_part int, _base long")
    out = rows.join(F.broadcast(base), "_part").withColumn("start", F.col("_base") + F.col("_start"))
    return out.drop("_part", "_start", "_base")
