"""Per-parent metadata: stable ids, facets, the local guardrail, privacy flags, keywords. Extensions of the index format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# What a reviewer should look at. A match flags; no match says nothing.
PRIVACY_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?:\+1[ .-]?)?\(?\b\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "record_number": r"(?i)\b(?:mrn|medical record)\b\D{0,12}\d{5,}",
    "birth_date": r"(?i)\b(?:dob|date of birth|born)\b\D{0,12}\d{1,4}[/-]\d{1,2}[/-]\d{1,4}",
}


def source_type(url: Column) -> Column:
    video = urls.host(url).rlike(r"(^|\.)(youtube\.com|youtu\.be)$")
    return F.when(url.startswith("file:"), "local").when(urls.is_git_host(url), "github").when(urls.is_portal(url), "kb").when(video, "youtube").otherwise("web")


def content_type(url: Column) -> Column:
    kind = source_type(url)
    readme = F.lower(F.element_at(F.split(urls.path(url), "/"), -1)).rlike(r"^readme(\.|$)")
    return F.when(readme, "readme").when(kind == "kb", "article").when(kind == "youtube", "video_transcript").otherwise("page")


def categories(url: Column) -> Column:
    """Folders of the path, outermost first."""
    parts = F.filter(F.split(urls.path(url), "/"), lambda x: x != "")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def describe(parents: DataFrame) -> DataFrame:
    """parents with id, source_type, content_type, categories, local and the reserved, null fields."""
    u = F.col("u")
    none = F.lit(None)
    return parents.select(
        *parents.columns,
        urls.stable_id(u, F.coalesce("t", F.lit(""))).alias("id"),
        source_type(u).alias("source_type"),
        content_type(u).alias("content_type"),
        categories(u).alias("categories"),
        (source_type(u) == "local").alias("local"),
        none.cast("string").alias("summary"),
        none.cast("array<string>").alias("tags"),
        none.cast("array<string>").alias("keywords"),
        none.cast("timestamp").alias("enriched_at"),
        none.cast("string").alias("enrich_ver"),
    )


def child_ids(children: DataFrame, parent_id: str = "id", ordinal: str = "ordinal") -> DataFrame:
    return children.withColumn("child_id", F.concat(F.col(parent_id), F.lit("-"), F.col(ordinal).cast("string")))


def for_web(parents: DataFrame, include_local: bool = False) -> DataFrame:
    """What web-facing outputs may hold: no local rows, unless told otherwise."""
    return parents if include_local else parents.filter(~F.coalesce("local", F.lit(False)))


def privacy_flags(rows: DataFrame, text: str = "x") -> DataFrame:
    """rows with `privacy_flags`: names of patterns to review. It never states that there is nothing."""
    flags = F.array(*[F.when(F.col(text).rlike(p), name) for name, p in PRIVACY_PATTERNS.items()])
    return rows.withColumn("privacy_flags", F.array_compact(flags))
