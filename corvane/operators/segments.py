"""Delta builds: an index as segments that only grow, with tombstones, merged statistics and vectors by content.

A delta takes the site as it is now. Pages whose content the index doesn't hold are read, cut and counted into a segment
of their own; what the index held for pages that changed or went is marked dead by (segment, url). Nothing else is
touched, so a delta costs what changed:

    order     url, ord of all pages now (the last one counts)      dead    was (segment), url
    pages     url, sha256                                           df      term, df: plus new chunks, minus dead ones
    parents   url, local_pid, ...                                   totals  docs, terms: likewise
    chunks    url, pid, ordinal, ..., text_sha, len, terms          vectors text_sha, embedding of texts not yet embedded
    manifest, written last: what makes the segment count

Every table of a segment is a folder `<table>/segment=<n>`, overwritten if a delta is tried again; a delta that fails
before its manifest leaves no trace. Document frequencies, lengths and averages are sums over segments. `compact` numbers
what lives in page order, as a build from nothing would.

Frequencies are counted within a chunk's row, from its terms. Bodies are shuffled once where pages are compared, and not
at all by a first build; vectors once, when `compact` has numbered all else.

A page is a url; pages are taken once (of rows that repeat a url any one). Null bodies give no chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import Bm25, ChunkSizes
from . import bm25
from .chunking import children, parents
from .embedding import Embedder, embed, embed_text, hash_embedder
from .pages import read_pages
from .positions import with_positions

_CHUNK = ["url", "pid", "ordinal"]


class Segments:
    """The segments under a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str, make: Callable[[], Embedder] = hash_embedder, sizes: ChunkSizes = ChunkSizes(), generic: list[str] | None = None):
        self.spark, self.path, self.make, self.sizes, self.generic = spark, path.rstrip("/"), make, sizes, generic

    def committed(self) -> int:
        """How many segments count; they are numbered from 0."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        n = 0
        while fs.exists(hadoop(f"{self.path}/manifest/segment={n}/_SUCCESS")):
            n += 1
        return n

    def table(self, name: str) -> DataFrame | None:
        """Rows of all segments with their number `segment`; None before the first."""
        n = self.committed()
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={i}" for i in range(n)]) if n else None

    def _alive(self, rows: DataFrame) -> DataFrame:
        dead = self.table("dead").select(F.col("was").alias("segment"), "url")
        return rows.join(dead, ["segment", "url"], "left_anti")

    def live(self, name: str) -> DataFrame:
        """Rows of pages, parents, chunks or tf (url, pid, ordinal, term, tf of chunks) that aren't dead."""
        if name == "tf":
            rows = self.live("chunks").select("segment", *_CHUNK, F.explode_outer(bm25.counted(F.col("terms"))).alias("_t"))
            return rows.filter("_t is not null").select("segment", *_CHUNK, "_t.term", "_t.tf")
        return self._alive(self.table(name))

    def _put(self, df: DataFrame, name: str, n: int) -> DataFrame:
        path = f"{self.path}/{name}/segment={n}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def apply(self, web: DataFrame) -> None:
        """Take the site as it is now: web (url, body, ord)."""
        n, empty = self.committed(), lambda ddl: self.spark.createDataFrame([], ddl)
        sha = F.sha2(F.coalesce("body", F.lit("")), 256).alias("sha256")
        now = self._put(web.select("url", "ord", sha).dropDuplicates(["url"]), "order", n)
        held = self.live("pages").select("segment", "url", "sha256") if n else empty("segment int, url string, sha256 string")
        fresh = self._put(now.join(held, ["url", "sha256"], "left_anti").select("url", "sha256"), "pages", n)
        dead = self._put(held.join(now, ["url", "sha256"], "left_anti").select(F.col("segment").alias("was"), "url"), "dead", n)

        once = web.count() == now.count()
        bodies = web.filter("url is not null").select("url", "body", sha)
        if n or not once:
            bodies = bodies.join(fresh, ["url", "sha256"], "left_semi")
        if not once:
            bodies = bodies.dropDuplicates(["url"])
        found = read_pages(bodies.select("url", "body"), generic=self.generic).select("url", "title", "sections")
        parent = self._put(parents(found, "url", sizes=self.sizes), "parents", n)
        child = children(parent.withColumnRenamed("local_pid", "pid"), self.sizes).withColumn("text_sha", F.sha2(embed_text(F.col("t"), F.col("x")), 256))
        terms = bm25.doc_tokens(child.withColumn("doc", F.struct(*_CHUNK, "text_sha", "u", "host", "kind", "weight", "t", "x")))
        chunk = self._put(terms.select("doc.*", F.size("terms").cast("bigint").alias("len"), "terms"), "chunks", n)

        count = lambda rows, sign: bm25.row_frequencies(rows).select("term", (sign * F.col("df")).alias("df"))
        total = lambda rows, sign: rows.agg((sign * F.count("*")).alias("docs"), (sign * F.coalesce(F.sum("len"), F.lit(0))).alias("terms"))
        df, totals = count(chunk, 1), total(chunk, 1)
        if n:
            gone = dead.withColumnRenamed("was", "segment")
            df = df.unionByName(count(self.table("chunks").join(gone, ["segment", "url"], "left_semi"), -1))
            totals = totals.unionByName(total(self.table("chunks").join(gone, ["segment", "url"], "left_semi"), -1))
        self._put(df.groupBy("term").agg(F.sum("df").alias("df")), "df", n)
        self._put(totals.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")), "totals", n)

        new = chunk.select("text_sha", embed_text(F.col("t"), F.col("x")).alias("text")).dropDuplicates(["text_sha"])
        known = self.table("vectors")
        new = new if known is None else new.join(known, "text_sha", "left_anti")
        vectors = self._put(embed(new, self.make, F.col("text")).drop("text"), "vectors", n)
        row = (n, fresh.count(), dead.count(), chunk.count(), vectors.count())
        self._put(self.spark.createDataFrame([row], "segment_id int, pages bigint, dead bigint, chunks bigint, embedded bigint"), "manifest", n)

    def history(self) -> DataFrame:
        """What each delta did: segment_id, pages, dead, chunks, embedded."""
        return self.table("manifest").drop("segment")

    def document_frequencies(self) -> DataFrame:
        return self.table("df").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def statistics(self, p: Bm25 = Bm25()) -> DataFrame:
        t = self.table("totals").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms"))
        return t.select(F.lit(p.k).alias("k"), F.lit(p.b).alias("b"), F.lit(p.d).alias("d"), "docs", F.coalesce(F.col("terms") / F.nullif("docs", F.lit(0)), F.lit(0.0)).alias("avg_doc_len"))

    def compact(self) -> tuple[DataFrame, DataFrame]:
        """(parents with pid, chunks with doc, pid and embedding): what lives, numbered in page order."""
        order = self.table("order").filter(F.col("segment") == self.committed() - 1).select("url", "ord")
        parent = with_positions(self.live("parents").join(order, "url").drop("segment"), ["ord", "local_pid"], "_pid")
        place = parent.select("url", F.col("local_pid").alias("pid"), "_pid")
        chunk = self.live("chunks").drop("segment", "terms", "len").join(place, ["url", "pid"]).drop("pid").withColumnRenamed("_pid", "pid")
        chunk = with_positions(chunk, ["pid", "ordinal"], "doc").drop("ordinal", "url")
        chunk = chunk.join(self.table("vectors").drop("segment"), "text_sha").drop("text_sha")
        return parent.drop("ord", "local_pid", "url").withColumnRenamed("_pid", "pid"), chunk

    def merged(self, path: str) -> Segments:
        """The same index as one segment under another path: dead rows are left out for good."""
        out = Segments(self.spark, path, self.make, self.sizes, self.generic)
        last = self.committed() - 1
        out._put(self.table("order").filter(F.col("segment") == last).drop("segment"), "order", 0)
        pages = out._put(self.live("pages").drop("segment"), "pages", 0)
        out._put(self.table("dead").drop("segment").limit(0), "dead", 0)
        out._put(self.live("parents").drop("segment"), "parents", 0)
        chunk = out._put(self.live("chunks").drop("segment"), "chunks", 0)
        out._put(self.document_frequencies(), "df", 0)
        out._put(self.table("totals").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")), "totals", 0)
        vectors = out._put(self.table("vectors").drop("segment").join(chunk.select("text_sha").distinct(), "text_sha", "left_semi"), "vectors", 0)
        row = (0, pages.count(), 0, chunk.count(), vectors.count())
        out._put(self.spark.createDataFrame([row], "segment_id int, pages bigint, dead bigint, chunks bigint, embedded bigint"), "manifest", 0)
        return out
