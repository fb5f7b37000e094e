"""Host-level quality rules.

Each text is measured once; a document fails its rules on its own figures. Failures are then counted by host, each
host's failure rate is shrunk towards the corpus rate with a beta prior fitted to all hosts (method of moments on the
overdispersion of host rates), and a host whose shrunken rate is above `max_host_rate` is rejected with all its
documents. Words are maximal runs of non-blank bytes.

Defined cases: null text is an empty text (no words, so it fails); a null host is no host: its documents are judged by
their own rules only and don't count for the prior; equal rows count each; an empty table gives no rows; other columns
are ignored. Hosts are small rows: they are broadcast up to `broadcast_hosts`, beyond that joined by shuffle with
documents of a host spread over `salt` keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import stage

_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\r\x0b\x0c"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_host_rate: float = 0.5
    max_strength: float = 1e6
    broadcast_hosts: int = 200_000
    salt: int = 64


def repeated_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, k: int = 3) -> np.ndarray:
    """Words of each document in k-word windows that its text holds twice or more.

    Windows are equal if their 64-bit hashes are: for a text of a million words a chance of 3e-8 to differ.
    """
    n = len(first) - 1
    g = B.grams(B.span_hashes(buf, starts, ends), k)
    at = np.flatnonzero(B.in_document(first, k, len(g))) if len(g) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((g[at], doc[at]))
    s = at[order]
    same = (g[s][1:] == g[s][:-1]) & (doc[s][1:] == doc[s][:-1])
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = s[twice]
    mask = B.covered(len(starts), hit, hit + k) if len(hit) else np.zeros(len(starts), bool)
    return np.bincount(doc[mask], minlength=n)


def text_stats(text: Column, docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """keep's columns and STATS of each row's text."""
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], text.cast("string").alias("_text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1]) + "".join(f", {c} long" for c in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = B.text_array(batch.column(batch.num_columns - 1))
            for lo, hi in B.slices(texts):
                buf, offs = B.raw(texts.slice(lo, hi - lo))
                starts, ends, first = B.word_spans(buf, offs, B.NOT_BLANK)
                inner = (B.NOT_BLANK[buf] & ((buf & 0xC0) != 0x80)).astype(np.int64)
                chars = np.diff(np.concatenate([[0], np.cumsum(inner)])[offs])
                sym = np.zeros(256, np.int64)
                sym[list(_SYMBOLS)] = 1
                symbols = np.diff(np.concatenate([[0], np.cumsum(sym[buf])])[offs])
                data, dup = buf.tobytes(), []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    lines = [x for x in data[a:b].split(b"\n") if x.strip(_BLANK)]
                    dup.append(len(lines) - len(set(lines)))
                figures = [np.diff(first), chars, symbols, np.array(dup, np.int64), repeated_words(buf, starts, ends, first)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(f.astype(np.int64)) for f in figures]], [*part.schema.names[:-1], *STATS])

    return rows.mapInArrow(run, schema)


def rule_failures(rules: Rules) -> dict[str, Column]:
    """Whether a document fails a rule, by rule."""
    return {"few_words": F.col("n_words") < rules.min_words, "repeats": 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")}


def base_failed(rules: Rules) -> Column:
    few, repeats = rule_failures(rules).values()
    return few | repeats


def domain(source: Column) -> Column:
    """Host of a URL, in lower case, without user, port and a leading www; any other name as it is."""
    host = F.lower(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.when(source.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_replace(host, r"^www\.", "")).otherwise(source)


def beta_prior(hosts: DataFrame, rules: Rules) -> tuple[float, float]:
    """(alpha, beta) from rows host, n, f (documents, failures): the corpus rate, and the strength that the spread of host rates leaves."""
    a = hosts.agg(F.count("*").alias("k"), F.sum("n").cast("double").alias("n"), F.sum("f").cast("double").alias("f"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not a["n"]:
        return 0.0, 0.0
    m = a["f"] / a["n"]
    v = m * (1 - m)
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("f") / F.col("n") - m, 2)).alias("s")).first()["s"]
    room = a["n"] - a["nn"] / a["n"]
    between = (spread - (a["k"] - 1) * v) / room if room > 0 else 0.0
    strength = min(max(v / between - 1, 1.0), rules.max_strength) if between > 0 else rules.max_strength
    return m * strength, (1 - m) * strength


def apply_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents: id_col, host, STATS, base_failed, host_rate, kept; hosts: host, n, f, host_rate, host_rejected, and of each rule f_<rule>, rate_<rule>: its failures and their rate, shrunk by the rule's own prior).

    A document is out if it fails a rule, or if its host's rate of documents that fail any is above max_host_rate.
    """
    stats = stage(text_stats(F.col(text_col), docs, {id_col: F.col(id_col), "host": domain(F.col(host_col).cast("string"))}).withColumn("base_failed", base_failed(rules)), "rules")
    hosts = stage(stats.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"), *[F.sum(failed.cast("long")).alias(f"f_{name}") for name, failed in rule_failures(rules).items()]), "hosts")
    alpha, beta = beta_prior(hosts, rules)
    hosts = hosts.withColumn("host_rate", (F.col("f") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta)))
    hosts = hosts.withColumn("host_rejected", F.col("host_rate") > rules.max_host_rate)
    for name in rule_failures(rules):
        a, b = beta_prior(hosts.select("host", "n", F.col(f"f_{name}").alias("f")), rules)
        hosts = hosts.withColumn(f"rate_{name}", (F.col(f"f_{name}") + F.lit(a)) / (F.col("n") + F.lit(a + b)))
    verdicts = hosts.select("host", "host_rate", "host_rejected")
    if hosts.limit(rules.broadcast_hosts + 1).count() <= rules.broadcast_hosts:
        joined = stats.join(F.broadcast(verdicts), "host", "left")
    else:
        spread = stats.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in stats.columns if c != "host"]), F.lit(rules.salt)).cast("int"))
        joined = spread.join(verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(rules.salt - 1)))), ["host", "_salt"], "left").drop("_salt")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))
    return joined.select(id_col, "host", *STATS, "base_failed", "host_rate", kept.alias("kept")), hosts
