"""Facets of search hits, as bitmaps of documents.

A category path has a facet at each of its levels (`a`, `a/b`, `a/b/c`). The documents of a facet, and those that hold a
term, are bitmaps in buckets of 32,768 documents, so a set costs a bit a document and bucket. A query's hits are the
union of its terms' bitmaps, and a facet's count is the size of their intersection: no row is made for a query and a
document. Every set is split by bucket, so none, however frequent its value, is in one row.

Documents are numbered by integers from 0; rows without a number or a path have no facet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def levels(path: Column) -> Column:
    """array<struct<level,value>> of a category path (array<string>)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1))), lambda i: F.struct(i.cast("bigint").alias("level"), F.array_join(F.slice(path, F.lit(1), i), "/").alias("value")))


def bitmaps(rows: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """(keys, bucket, bits) of the documents of each key."""
    at = F.col(doc).cast("bigint") + 1
    some = rows.filter(F.col(doc).isNotNull())
    return some.groupBy(*keys, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def facet_bitmaps(docs: DataFrame, path: str = "categories", doc: str = "doc") -> DataFrame:
    """(level, value, bucket, bits) from documents with their category path."""
    rows = docs.filter(F.size(path) > 0).select(doc, F.explode(levels(F.col(path))).alias("_f")).select(doc, "_f.level", "_f.value")
    return bitmaps(rows, ["level", "value"], doc)


def hit_bitmaps(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, bucket, bits): documents that hold any term of a query. queries: query_id, text; terms: doc, terms."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    held = terms.select("doc", F.explode(F.array_distinct("terms")).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    return wanted.join(bitmaps(held, ["term"]), "term").groupBy("query_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def facet_counts(hits: DataFrame, facets: DataFrame) -> DataFrame:
    """(query_id, level, value, hits) of each query and facet that share a document."""
    both = hits.join(facets.withColumnRenamed("bits", "_bits"), "bucket").select("query_id", "level", "value", "bucket", F.explode(F.array("bits", "_bits")).alias("bits"))
    shared = both.groupBy("query_id", "level", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return shared.groupBy("query_id", "level", "value").agg(F.sum(F.bitmap_count("bits")).alias("hits")).filter("hits > 0")
