"""The revalidating page cache as a relational state machine.

A request meets its cache row and the server's response, and one CASE decides what is returned and stored:

    response with an error or none                        nothing, cache unchanged
    304 to a conditional request, body in the cache       cached body, fetched_at moves on
    304 to a conditional request, body lost               a second, plain response decides
    other status of 400 or more                           nothing, cache unchanged
    content type neither expected kind                    nothing, cache unchanged
    else                                                  the body, and a new cache row
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import cache_path


def has_text(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def conditional_headers(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests with if_none_match and if_modified_since: stored validators as they are, null without one."""
    known = cache.select("url", F.when(has_text(F.col("etag")), F.col("etag")).alias("if_none_match"), F.when(has_text(F.col("last_modified")), F.col("last_modified")).alias("if_modified_since"))
    return requests.join(known, "url", "left")


def revalidate(requests: DataFrame, cache: DataFrame, responses: DataFrame, now: float | Column) -> DataFrame:
    """(url, conditional, outcome, body, etag, last_modified, fetched_at, sha256) for requests (url, expect_html).

    responses has rows of call_no 1 and, for a repeated call, 2; a null status is a failed call.
    """
    now = F.lit(float(now)) if isinstance(now, (int, float)) else now
    sent = conditional_headers(requests, cache)
    held = cache.select("url", *[F.col(c).alias(f"_{c}") for c in ("etag", "last_modified", "fetched_at", "sha256", "body")])
    kind = ("status", "content_type", "etag", "last_modified", "body")
    first, second = (responses.filter(F.col("call_no") == n).select("url", F.struct(*kind).alias(f"_r{n}")) for n in (1, 2))
    all_ = sent.join(held, "url", "left").join(first, "url", "left").join(second, "url", "left")
    conditional = F.col("if_none_match").isNotNull() | F.col("if_modified_since").isNotNull()
    unchanged = F.coalesce(conditional & (F.col("_r1.status") == 304), F.lit(False))
    again = unchanged & F.col("_body").isNull()
    r = F.when(again, F.col("_r2")).otherwise(F.col("_r1"))
    all_ = all_.withColumn("_c", conditional).withColumn("_hit", unchanged & F.col("_body").isNotNull()).withColumn("_r", r)
    wanted = F.when(F.col("expect_html"), F.lit("text/html")).otherwise(F.lit("text/plain"))
    good = F.coalesce((F.col("_r.status") < 400) & F.contains(F.coalesce("_r.content_type", F.lit("")), wanted), F.lit(False))
    outcome = F.when(F.col("_hit"), "not_modified").when(F.col("_r.status").isNull(), "failed").when(F.col("_r.status") >= 400, "failed").when(good, "stored").otherwise("mismatch")
    pick = lambda new, old: F.when(F.col("outcome") == "stored", new).otherwise(old)
    out = all_.withColumn("outcome", outcome)
    return out.select(
        "url",
        F.col("_c").alias("conditional"),
        "outcome",
        F.when(F.col("outcome") == "stored", F.coalesce("_r.body", F.lit(""))).when(F.col("outcome") == "not_modified", F.col("_body")).alias("body"),
        pick(F.col("_r.etag"), F.col("_etag")).alias("etag"),
        pick(F.col("_r.last_modified"), F.col("_last_modified")).alias("last_modified"),
        F.when(F.col("outcome").isin("stored", "not_modified"), now).otherwise(F.col("_fetched_at")).alias("fetched_at"),
        pick(F.sha2(F.coalesce("_r.body", F.lit("")), 256), F.col("_sha256")).alias("sha256"),
    )


def updated_cache(cache: DataFrame, found: DataFrame) -> DataFrame:
    """cache after found (a result of revalidate): untouched rows stay, stored and revalidated ones are replaced."""
    new = found.filter(F.col("outcome").isin("stored", "not_modified")).select("url", "etag", "last_modified", "fetched_at", "sha256", "body")
    return cache.select(new.columns).join(new.select("url"), "url", "left_anti").unionByName(new)


def with_paths(cache: DataFrame, folder: str = ".kb_cache/pages") -> DataFrame:
    return cache.withColumn("path", cache_path(F.col("url"), folder))


def changed(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of pages (url, body) that the cache doesn't hold with the same content: what a delta build works on."""
    known = cache.select("url", F.col("sha256").alias("_sha"))
    return pages.withColumn("_sha", F.sha2("body", 256)).join(known, ["url", "_sha"], "left_anti").drop("_sha")
