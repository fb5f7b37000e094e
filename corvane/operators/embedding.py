"""Vectors of chunks, from a model, a table or a hash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EMBED_BATCH, EMBED_DIMS

Embedder = Callable[[list[str]], np.ndarray]


def embed_text(t: Column, x: Column) -> Column:
    """What is embedded: heading, line break, text; the text alone without a heading."""
    return F.when(F.coalesce(t, F.lit("")) == "", x).otherwise(F.concat(t, F.lit("\n"), x))


def hash_embedder(dims: int = EMBED_DIMS) -> Embedder:
    """Deterministic unit vectors seeded by the text's SHA-256."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            v = np.random.default_rng(int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)).normal(size=dims).astype(np.float32)
            out[i] = v / np.linalg.norm(v)
        return out

    return embed


def embed(chunks: DataFrame, make: Callable[[], Embedder], text: Column, batch: int = EMBED_BATCH, out: str = "embedding") -> DataFrame:
    """chunks with a float array; make() is called once in each task (a model loads there)."""
    names = [f"_c{i}" for i in range(len(chunks.columns))]
    rows = chunks.select(*[F.col(c).alias(n) for c, n in zip(chunks.columns, names, strict=True)], text.alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = None
        for b in batches:
            embedder = embedder or make()
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                v = np.asarray(embedder([x or "" for x in part.column(part.num_columns - 1).to_pylist()]), np.float32)
                offs = pa.array(np.arange(len(v) + 1, dtype=np.int32) * (v.shape[1] if len(v) else 0))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offs, pa.array(v.ravel()))], [*names, "_v"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1]) + ", _v array<float>"
    return rows.mapInArrow(run, schema).toDF(*chunks.columns, out)


def join_embeddings(chunks: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Vectors that another system made, by key."""
    return chunks.join(table, key)
