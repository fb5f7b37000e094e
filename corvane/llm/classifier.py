"""Quality by nearest-neighbour voting in a latent space.

A text's features are counts of byte-class trigrams (letters by case, digits, blanks, every punctuation mark its own
class), of lower-case letter pairs, and a few shares (words that repeat the word before, distinct words, ...). A bounded
sample of labelled rows gives inverse document frequencies and, by their singular vectors, a latent space; the sample's
unit vectors, with their labels, are broadcast (at most 2 * max_per_class rows of `rank` numbers). Every document is
projected, its exact cosine with all labelled vectors is computed block by block, and its `neighbours` nearest vote,
weighted by similarity and by the inverse size of their class.

Fitting uses at most `max_per_class` rows of each label, those of least hash of their id; everything else covers all
rows. Only the text is ever an input of a score.

Defined cases: null and empty texts have one feature, that of few words, and are scored by it like any other; labels that are null or neither 0 nor 1 are not
learnt; if one label or all are missing, every score is the share of label 1 in the sample (0.5 without any); repeated
rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

SHAPES, PAIRS, SHARES = 1024, 512, 12
DIMS = SHAPES + PAIRS + SHARES
_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B] = 1
_CLASS[0x80:] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[0x20, 0x09, 0x0D]] = 4
_CLASS[0x0A] = 5
_MARKS = [b for b in range(0x21, 0x7F) if not _CLASS[b]]
_CLASS[_MARKS] = np.arange(6, 6 + len(_MARKS))
_N = int(_CLASS.max()) + 1
_SHAPE_BUCKET = (B.mix(np.arange(_N**3, dtype=B.U64) + B.U64(1)) % B.U64(SHAPES)).astype(np.int64)
_PAIR_BUCKET = (B.mix(np.arange(1 << 16, dtype=B.U64) + B.U64(1 << 40)) % B.U64(PAIRS)).astype(np.int64)


@dataclass(frozen=True)
class Settings:
    max_per_class: int = 2000
    rank: int = 48
    neighbours: int = 25
    sharpness: float = 8.0
    block: int = 512


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def _counts(doc: np.ndarray, bucket: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.bincount(doc * width + bucket, minlength=n * width).reshape(n, width).astype(np.float32)


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of DIMS non-negative numbers for each text; each family is the square root of relative counts."""
    n = len(offs) - 1
    size = np.diff(offs)
    out = np.zeros((n, DIMS), np.float32)
    doc = np.repeat(np.arange(n), size)
    if len(buf) > 2:
        inside = doc[2:] == doc[:-2]
        c = _CLASS[buf]
        shape = _SHAPE_BUCKET[(c[:-2] * _N + c[1:-1]) * _N + c[2:]]
        out[:, :SHAPES] = _counts(doc[:-2][inside], shape[inside], n, SHAPES)
        low = B.LOWER[buf].astype(np.int64)
        letters = (doc[1:] == doc[:-1]) & (c[:-1] <= 2) & (c[1:] <= 2)
        pair = _PAIR_BUCKET[low[:-1] * 256 + low[1:]]
        out[:, SHAPES : SHAPES + PAIRS] = _counts(doc[:-1][letters], pair[letters], n, PAIRS)
    starts, ends, first = B.word_spans(buf, offs, B.NOT_BLANK)
    h = B.span_hashes(buf, starts, ends)
    words = np.diff(first)
    wdoc = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    share = np.zeros((n, SHARES), np.float32)
    for lag in (1, 2, 3):
        if len(h) > lag:
            same = (h[lag:] == h[:-lag]) & (wdoc[lag:] == wdoc[:-lag])
            share[:, lag - 1] = np.bincount(wdoc[lag:][same], minlength=n) / some
    if len(h):
        order = np.lexsort((h, wdoc))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (wdoc[order][1:] != wdoc[order][:-1])
        distinct = np.bincount(wdoc[order][new], minlength=n)
        expected = np.minimum(1, 6 / np.sqrt(some))
        share[:, 3] = np.where(words > 0, np.clip(1 - distinct / some, 0, 1), 0)
        share[:, 4] = (words > 0) & (distinct / some < 0.5 * expected)
    if len(buf):
        c = _CLASS[buf]
        for k, which in ((5, c == 2), (6, c == 3), (7, c >= 6), (8, c == 5)):
            share[:, k] = np.bincount(doc[which], minlength=n) / np.maximum(size, 1)
    share[:, 9] = np.clip(np.log1p(words) / 12, 0, 1)
    share[:, 10] = words < 20
    share[:, 11] = np.clip(size / some / 40, 0, 1)
    for lo, hi in ((0, SHAPES), (SHAPES, SHAPES + PAIRS)):
        total = out[:, lo:hi].sum(1, keepdims=True)
        out[:, lo:hi] = np.sqrt(out[:, lo:hi] / np.maximum(total, 1))
    out[:, SHAPES + PAIRS :] = np.sqrt(share)
    return out


class Model:
    """Latent space and labelled vectors; predict() scores texts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, s: Settings):
        self.s, self.prior = s, float(y.mean()) if len(y) else 0.5
        self.ok = bool(len(y)) and 0 < self.prior < 1
        if not self.ok:
            return
        used = (x > 0).sum(0)
        self.scale = (np.log((1 + len(x)) / (1 + used)) + 0.3).astype(np.float32)
        self.scale[SHAPES : SHAPES + PAIRS] *= 0.5
        self.scale[SHAPES + PAIRS :] = 1.0
        z = x * self.scale
        self.mean = z.mean(0)
        z = z - self.mean
        value, vector = np.linalg.eigh((z.T @ z).astype(np.float64))
        self.basis = np.ascontiguousarray(vector[:, ::-1][:, : s.rank]).astype(np.float32)
        self.known = self._unit(z @ self.basis)
        self.vote = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()).astype(np.float32)
        self.label = y.astype(np.float32)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.ok:
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        k = min(self.s.neighbours, len(self.label))
        for lo in range(0, len(x), self.s.block):
            block = x[lo : lo + self.s.block]
            cos = self._unit((block * self.scale - self.mean) @ self.basis) @ self.known.T
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, top, 1), 1e-3) ** self.s.sharpness * self.vote[top]
            out[lo : lo + len(block)] = (w * self.label[top]).sum(1) / w.sum(1)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Model of the labelled rows of docs; give only those to learn from as labels (id_col, label_col)."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = B.text_array(batch.column(2))
            for lo, hi in B.slices(text):
                x = features(*B.raw(text.slice(lo, hi - lo))).astype(np.float16)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "_y", "_t", "_x"])

    x, y = [], []
    for label in (0, 1):
        some = marked.filter(F.col("_y") == label).orderBy(F.xxhash64("_id"), "_id").limit(s.max_per_class)  # at most max_per_class ids
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(some), "_id").select("_id", "_y", "_text", F.xxhash64("_text").alias("_t"))
        kind = dict(rows.dtypes)["_id"]
        seen = rows.mapInArrow(run, f"_id {kind}, _y int, _t long, _x binary").orderBy(F.xxhash64("_id"), "_t").limit(s.max_per_class).collect()
        x += [np.frombuffer(r["_x"], np.float16) for r in seen]
        y += [label] * len(seen)
    return Model(np.array(x, np.float32).reshape(len(y), DIMS), np.array(y, np.int64), s)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score (double) added; all their columns stay, but one of the score's name is replaced."""
    docs = docs.drop(out_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            text = B.text_array(batch.column(at))
            for lo, hi in B.slices(text):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.predict(features(*B.raw(text.slice(lo, hi - lo)))))], [*names, "_score"])

    out = rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", _score double")
    return out.toDF(*docs.columns, out_col)
