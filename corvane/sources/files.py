"""Where pages come from: tables of fetched pages, raw texts, local folders, conversations or captions, the cache's metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..schemas import CACHE

_META = "struct<etag:string,last_modified:string,fetched_at:double,sha256:string>"


def page_table(spark: SparkSession, path: str, url: str = "url", body: str = "html") -> DataFrame:
    """(url, body) of a Parquet table of pages; columns that aren't needed are never read."""
    return spark.read.parquet(path).select(F.col(url).alias("url"), F.col(body).alias("body"))


def text_documents(docs: DataFrame, base: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as plain-text files under a base URL: (doc_id, url, body)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.concat(F.lit(base), F.col(doc_id).cast("string"), F.lit(".txt")).alias("url"), F.col(text).alias("body"))


def local_files(spark: SparkSession, folder: str, pattern: str = "*.{md,markdown,txt,html,htm}") -> DataFrame:
    """(url, body, raw): files of a folder and its subfolders, each read whole by Spark; url is the file's URI."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("url"), F.col("content").cast("string").alias("body"), (~F.lower("path").rlike(r"\.html?$")).alias("raw"))


def repository_files(blobs: DataFrame) -> DataFrame:
    """Code hosts' text files of blobs (url, body) with the URL that serves each raw."""
    return blobs.filter(urls.is_git_text(F.col("url"))).withColumn("raw_url", urls.git_raw_url(F.col("url")))


def captions(turns: DataFrame, base: str, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Caption lines to one text for each video or conversation: (url, body), lines in order."""
    lines = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("x")))).alias("_l"))
    return lines.select(F.concat(F.lit(base), F.col(key).cast("string"), F.lit(".txt")).alias("url"), F.array_join(F.transform("_l", lambda x: x["x"]), "\n").alias("body"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cache_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(url, etag, last_modified, fetched_at, sha256) of one JSON object by URL; no rows if the file is missing or broken."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CACHE).drop("body")
    text = spark.read.text(path, wholetext=True)
    by_url = text.select(F.explode(F.from_json("value", f"map<string,{_META}>")).alias("url", "_m"))
    return by_url.select("url", "_m.etag", "_m.last_modified", "_m.fetched_at", "_m.sha256")


#: Rows that one JSON object of metadata may have (some 300 bytes each); a larger cache is a table, see cachesource.
METADATA_ROWS = 1_000_000


def save_cache_metadata(meta: DataFrame, path: str) -> None:
    """Write meta as that JSON object: to a folder beside path, then renamed in its place, so a reader sees all or nothing. ValueError for more than METADATA_ROWS rows."""
    spark = meta.sparkSession
    if meta.select("url").limit(METADATA_ROWS + 1).count() > METADATA_ROWS:
        raise ValueError(f"more than {METADATA_ROWS} pages: one JSON object can't be built in one task; write the cache as a table")
    entry = F.struct("url", F.struct("etag", "last_modified", "fetched_at", "sha256").alias("m"))
    one = meta.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry))), {"ignoreNullFields": "false"}).alias("value"))  # METADATA_ROWS at most
    jvm, part = spark._jvm, f"{path}.part"
    one.coalesce(1).write.mode("overwrite").text(part)
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    file = next(str(s.getPath()) for s in fs.listStatus(fs_path(part)) if str(s.getPath().getName()).startswith("part-"))
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE  # one step: a reader finds the old file or the new one
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fs_path(file)), fs.makeQualified(fs_path(path)), over)
    fs.delete(fs_path(part), True)
