"""Sections to parents, parents to children: column algebra, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import rfind, squeeze_breaks, strip
from ..schemas import ChunkSizes
from .positions import with_positions


def cut_parent(text: Column, sizes: ChunkSizes = ChunkSizes()) -> Column:
    """Pieces of a squeezed, stripped text: each ends at the last line break of its first parent_max characters if that leaves parent_min, blanks between pieces go; texts below parent_min give none, a last piece may be shorter.

    One linear pass of a pattern: what is left if it fits, else as far as a line break after parent_min, else parent_max.
    """
    most, least = sizes.parent_max, sizes.parent_min
    pieces = F.regexp_extract_all(text, F.lit(rf"(?sU)\G\s*+(.{{1,{most}}}\z|.{{{least},{most - 1}}}(?=\n)|.{{{most}}})"), F.lit(1))
    return F.when(F.length(text) < least, F.array().cast("array<string>")).otherwise(pieces)


def _windows(text: Column, sizes: ChunkSizes) -> Column:
    """Windows of child_max characters each child_step, trimmed at their last line break unless they reach the end, stripped, those of child_min kept; null for a text of child_max or less."""
    n, size, step = F.length(text), sizes.child_max, sizes.child_step
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))

    def window(s: Column) -> Column:
        piece = F.substring(text, s + 1, F.lit(size))
        where = rfind(piece, "\n")
        return strip(F.when((s + size < n) & (where > 0), F.substring(piece, F.lit(1), where)).otherwise(piece))

    return F.when(n > size, F.filter(F.transform(starts, window), lambda x: F.length(x) >= sizes.child_min))


def _or_whole(windows: Column, text: Column) -> Column:
    return F.when(F.coalesce(F.size(windows), F.lit(0)) < 1, F.array(text)).otherwise(windows)


def child_windows(text: Column, sizes: ChunkSizes = ChunkSizes()) -> Column:
    """The children of a parent's text: its windows; a text of child_max or less, or without a window, is its own child."""
    return _or_whole(_windows(text, sizes), text)


def parents(pages: DataFrame, order: str, url: str = "url", sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """(order, t, x, u, host, kind, weight, local_pid) of pages with title and sections."""
    # A page's pieces are an array of its own row: no shuffle, and pages that repeat id and URL stay apart. The outer form
    # of the generator keeps the optimizer from evaluating it once more as a filter of its own.
    def pieces(section: Column) -> Column:
        heading = F.when(section["heading"].isNull(), F.col("title")).otherwise(F.concat("title", F.lit(" -- "), section["heading"]))
        return F.transform(cut_parent(squeeze_breaks(F.coalesce(section["text"], F.lit(""))), sizes), lambda x: F.struct(heading.alias("t"), x.alias("x")))

    out = pages.select(F.col(order).alias("_page"), F.col(url).alias("u"), F.posexplode_outer(F.flatten(F.transform("sections", pieces))).alias("local_pid", "_c")).filter("_c is not null")
    return out.select(F.col("_page").alias(order), F.col("_c.t").alias("t"), F.col("_c.x").alias("x"), "u", urls.host(F.col("u")).alias("host"), urls.kind(F.col("u")).alias("kind"), F.lit(1.0).alias("weight"), F.col("local_pid").cast("bigint").alias("local_pid"))


def number_parents(parent: DataFrame, order: str) -> DataFrame:
    """parents with their global 0-based `pid` in page order instead of local_pid."""
    return with_positions(parent, [order, "local_pid"], "pid").drop("local_pid")


def children(parent: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """Rows of parents (with pid) to rows of children: parent's columns with x replaced, and `ordinal` within the parent."""
    rest = [c for c in parent.columns if c != "x"]
    cut = parent.select("*", _windows(F.col("x"), sizes).alias("_w"))  # evaluated once, used twice
    out = cut.select(*rest, F.posexplode_outer(_or_whole(F.col("_w"), F.col("x"))).alias("ordinal", "x"))
    return out.withColumn("ordinal", F.col("ordinal").cast("bigint"))


def number_children(child: DataFrame) -> DataFrame:
    """children with their global 0-based position `doc` instead of ordinal."""
    return with_positions(child, ["pid", "ordinal"], "doc").drop("ordinal")
