"""Incremental forms of the cache and the chunker, as Structured Streaming queries (extensions).

The engine's build is a batch. A feed of fetched pages can keep the cache table current instead: each micro-batch is one
commit, which is also the interval at which metadata is flushed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import urls
from ..functions.text import squeeze_breaks
from ..operators.cache import changed
from ..operators.chunking import child_windows, cut_parent
from ..operators.pages import read_texts


def latest(pages: DataFrame) -> DataFrame:
    """The last row of each URL by fetched_at."""
    w = Window.partitionBy("url").orderBy(F.col("fetched_at").desc(), F.sha2("body", 256))
    return pages.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cache_writer(pages: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Append each micro-batch's changed pages (url, body, fetched_at) to a table of versions under folder; `latest` reads the cache."""

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = latest(batch).withColumn("sha256", F.sha2("body", 256))
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = changed(rows.drop("sha256"), latest(spark.read.parquet(folder).filter(F.col("batch") < number))).withColumn("sha256", F.sha2("body", 256))
        # A repeated batch replaces its own partition, so each page version is there once.
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return pages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def stream_children(texts: DataFrame) -> DataFrame:
    """(doc_id, t, x, u, host, kind, weight, parent, ordinal) of a stream of plain texts (doc_id, url, body): stateless, so any batch or stream does."""

    pages = read_texts(texts)
    one = pages.select("doc_id", "url", "title", F.explode("sections").alias("_s"))
    parent = one.select("doc_id", F.col("url").alias("u"), F.col("title").alias("t"), F.posexplode(cut_parent(squeeze_breaks(F.col("_s.text")))).alias("parent", "_x"))
    return parent.select("doc_id", "t", "u", urls.host(F.col("u")).alias("host"), urls.kind(F.col("u")).alias("kind"), F.lit(1.0).alias("weight"), "parent", F.posexplode(child_windows(F.col("_x"))).alias("ordinal", "x"))
