"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector, drawn from its code point. A trigram is bound: the letters' vectors, rotated by
two, one and no places, are multiplied elementwise. A text's vector is the sum (bundle) of its trigrams' vectors, a
language's prototype the sum over its texts, each scaled to weigh alike; the language of nearest cosine is predicted.
Letters are lower-cased Unicode letters; runs of anything else read as one blank, which has a vector too.

Prototypes are bundled over all given rows: each task sums trigram counts by language and emits one vector for each
language, which are added by (language, position). Vectors are made for a bounded number of trigrams at a time, and texts
are read a bounded number at a time, so memory doesn't grow with a text's distinct trigrams.

Prototypes are held whole by the driver and every worker, so languages are limited: more than `max_languages` distinct
ones raise ValueError before any text is read.

Defined cases: null texts, and texts without a letter, are `und` with score 0; null languages are not learnt; without
any prototype every text is `und`; ties go to the language that sorts first; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

DIMS, SEED = 1024, 17
_BLANK = 0
#: Trigrams whose vectors are held at once, and texts that are read at once.
KEYS, TEXTS = 4096, 1024
MAX_LANGUAGES = 2000
_tables: dict[str, np.ndarray] = {}
_vectors: dict[int, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """Lower-cased letter by code point; 0 for what is no letter."""
    if "letter" not in _tables:
        t = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _tables["letter"] = t
    return _tables["letter"]


def letter_vector(letter: int) -> np.ndarray:
    v = _vectors.get(letter)
    if v is None:
        v = _vectors[letter] = np.random.default_rng([SEED, letter]).integers(0, 2, DIMS).astype(np.int8) * 2 - 1
    return v


def gram_vectors(keys: np.ndarray) -> np.ndarray:
    """A float32 row for each packed trigram (21 bits a letter)."""
    out = np.empty((len(keys), DIMS), np.float32)
    parts = [((keys >> shift) & 0x1FFFFF) for shift in (42, 21, 0)]
    letters = np.unique(np.concatenate(parts)) if len(keys) else np.zeros(0, np.int64)
    rolled = [np.array([np.roll(letter_vector(int(x)), k) for x in letters], np.int8).reshape(len(letters), DIMS) for k in (2, 1, 0)]
    at = [np.searchsorted(letters, p) for p in parts]
    for lo in range(0, len(keys), 1024):
        s = slice(lo, lo + 1024)
        out[s] = rolled[0][at[0][s]] * rolled[1][at[1][s]] * rolled[2][at[2][s]]
    return out


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, index into keys, keys, letters of each document) of every trigram of the texts."""
    data = [t.encode("utf-32-le", "replace") for t in texts.to_pylist()]
    size = np.array([len(d) // 4 for d in data], np.int64)
    code = letter_table()[np.minimum(np.frombuffer(b"".join(data), "<u4"), 0x10FFFF)].astype(np.int64)
    doc = np.repeat(np.arange(len(data)), size)
    letters = np.bincount(doc[code > 0], minlength=len(data))
    # One blank before each text, and one for each run of other characters.
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    alphabet, at = np.unique(code, return_inverse=True)
    a = len(alphabet)
    inside = doc[2:] == doc[:-2]
    if a**3 <= 1 << 22:
        small = ((at[:-2] * a + at[1:-1]) * a + at[2:])[inside]
        present = np.flatnonzero(np.bincount(small, minlength=a**3))
        number = np.zeros(a**3, np.int64)
        number[present] = np.arange(len(present))
        keys = (alphabet[present // (a * a)] << 42) | (alphabet[present // a % a] << 21) | alphabet[present % a]
        return doc[:-2][inside], number[small], keys, letters
    keys, number = np.unique(((code[:-2] << 42) | (code[1:-1] << 21) | code[2:])[inside], return_inverse=True)
    return doc[:-2][inside], number, keys, letters


class Profiles:
    """Unit prototypes by language."""

    def __init__(self, names: list[str], vectors: np.ndarray):
        order = np.argsort(np.array(names, object), kind="stable") if names else []
        self.names = [names[i] for i in order]
        v = vectors[order] if names else np.zeros((0, DIMS))
        self.unit = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.held: dict[int, np.ndarray] = {}

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, score = [], np.zeros(len(texts))
        for lo in range(0, len(texts), TEXTS):
            some = texts.slice(lo, TEXTS)
            found, score[lo : lo + TEXTS] = self._predict(some)
            names += found
        return names, score

    def _predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        doc, number, keys, letters = trigrams(texts)
        n = len(texts)
        names, score = ["und"] * n, np.zeros(n)
        if not self.names:
            return names, score
        bundle = np.zeros((n, DIMS), np.float32)
        for mine, at, vectors in _blocks(number, keys):
            where = doc if mine is None else doc[mine]
            for lo in range(0, n, 256):
                hi = min(lo + 256, n)
                a, b = np.searchsorted(where, [lo, hi])
                counts = np.bincount((where[a:b] - lo) * len(vectors) + at[a:b], minlength=(hi - lo) * len(vectors)).reshape(hi - lo, len(vectors)).astype(np.float32)
                used = counts.any(0)
                bundle[lo:hi] += counts[:, used] @ vectors[used]
        cos = bundle @ self.unit.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-9)
        best = cos.argmax(1)
        for i in np.flatnonzero(letters).tolist():
            names[i] = self.names[best[i]]
            score[i] = min(max(float(cos[i, best[i]]), 0.0), 1.0)
        return names, score


def _blocks(number: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
    """(which trigrams, or None for all; their rows in vectors; vectors) for KEYS distinct trigrams at a time."""
    for lo in range(0, len(keys), KEYS):
        vectors = gram_vectors(keys[lo : lo + KEYS])
        if len(keys) <= KEYS:
            yield None, number, vectors
        else:
            mine = np.flatnonzero((number >= lo) & (number < lo + KEYS))
            yield mine, number[mine] - lo, vectors


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_languages: int = MAX_LANGUAGES) -> Profiles:
    """Profiles of all rows of docs with a language; ValueError if there are more than max_languages."""
    rows = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")).filter("_lang is not null and _text is not null")
    if rows.select("_lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            text, langs = B.text_array(batch.column(1)), np.array(batch.column(0).to_pylist(), object)
            for lo, hi in B.slices(text, 1 << 20):
                for lo in range(lo, hi, TEXTS):
                    _add(sums, text.slice(lo, min(TEXTS, hi - lo)), langs[lo : min(lo + TEXTS, hi)])
        if sums:
            names = [name for name in sums for _ in range(DIMS)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.tile(np.arange(DIMS, dtype=np.int32), len(sums))), pa.array(np.concatenate(list(sums.values())).astype(np.float64))], ["lang", "i", "v"])

    total = rows.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).toArrow()  # at most max_languages x DIMS numbers
    langs = total.column("lang").combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    names = langs.dictionary.to_pylist()
    vectors = np.zeros((len(names), DIMS))
    vectors[langs.indices.to_numpy(), total.column("i").to_numpy()] = total.column("v").to_numpy()
    return Profiles(names, vectors)


def _add(sums: dict[str, np.ndarray], text: pa.Array, langs: np.ndarray) -> None:
    """Adds each text's trigram vectors, scaled to weigh alike, to its language's sum."""
    doc, number, keys, _ = trigrams(text)
    weight = 1 / np.maximum(np.bincount(doc, minlength=len(text)), 1)
    names, which = np.unique(langs.astype(str), return_inverse=True)
    for mine, at, vectors in _blocks(number, keys):
        where = doc if mine is None else doc[mine]
        for j in np.unique(which[where]).tolist():
            own = which[where] == j
            total = np.bincount(at[own], weights=weight[where[own]], minlength=len(vectors))
            sums[names[j]] = sums.get(names[j], 0) + total.astype(np.float32) @ vectors


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (if None, all but the text, and but those of the names added) with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")] if keep is None else keep
    names = [f"_c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = held.value
        for batch in batches:
            text = B.text_array(batch.column(batch.num_columns - 1))
            for lo, hi in B.slices(text, 1 << 20):
                found, score = profiles.predict(text.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(found, pa.string()), pa.array(score)], [*names, "_lang", "_score"])

    out = rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1]) + ", _lang string, _score double")
    return out.toDF(*keep, "lang_pred", "score")
