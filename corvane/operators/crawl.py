"""A breadth-first walk of a link table, level by level, in the order of a first-in first-out queue.

Within a level, pages come in the order in which they were first named: by the visit number of the page that names them,
then by the link's place on it. A page counts as visited, and towards max_pages, before it is fetched. The seed is never
checked against the scope; every other link is, once, when it is first named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..schemas import DEFAULT_SITE, MAX_PAGES, ChunkSizes
from ..session import keep, shared_path
from .chunking import children, number_children, number_parents, parents
from .pages import read_pages
from .positions import with_positions


#: Buckets of visited URLs, and rows of a level up to which they are looked up in memory (20 MB at most).
BUCKETS, HELD_ROWS = 16, 100_000


class _Visited:
    """Visited URLs as parts that are only added to, a level each, in buckets by URL; eight parts of like size are merged, so there are few, and a URL is written as often as the logarithm of their number."""

    def __init__(self, spark: SparkSession):
        self.spark, self.parts = spark, []

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("url string, visit_seq bigint, bucket int").parquet(*paths) if len(paths) == 1 else self._rows(paths[:1]).unionByName(self._rows(paths[1:]))

    def _write(self, rows: DataFrame) -> str:
        path = shared_path(self.spark, "visited")
        rows.withColumn("bucket", _bucket("url")).repartition("bucket").write.partitionBy("bucket").parquet(path)
        return path

    def add(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """The rows, written, and how many they are."""
        path = self._write(rows)
        out = self._rows([path]).select("url", "visit_seq")
        if n := out.count():
            self.parts.append((path, n))
        size = lambda part: (part[1].bit_length() - 1) // 3
        while len(self.parts) >= 8 and len({size(p) for p in self.parts[-8:]}) == 1:
            some = self.parts[-8:]
            self.parts[-8:] = [(self._write(self._rows([p for p, _ in some]).drop("bucket")), sum(n for _, n in some))]
        return out, n

    def rows(self) -> DataFrame:
        return self._rows([p for p, _ in self.parts]).select("url", "visit_seq") if self.parts else self.spark.createDataFrame([], "url string, visit_seq bigint")

    def known(self, links: DataFrame, n: int, some: list[int]) -> DataFrame:
        """Those of n distinct links, which are in some buckets, that are visited. The visited rows of these buckets are read, but not moved if the links are few."""
        rows = self._rows([p for p, _ in self.parts]).filter(F.col("bucket").isin(some)).select(F.col("url").alias("link"))
        return rows.join(F.broadcast(links.select("link")) if n <= HELD_ROWS else links.select("link"), "link", "left_semi")


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int").alias("bucket")


def walk(spark: SparkSession, links: DataFrame, seed: str, max_pages: int | None = MAX_PAGES, scope: Column | None = None) -> DataFrame:
    """(url, visit_seq) of visited pages. links: (url, place, link), one row for each link in page order; scope: a predicate on `link`; max_pages None: no limit."""
    edges = links.filter("link is not null")
    edges = edges if scope is None else edges.filter(scope)
    level = spark.createDataFrame([(seed, 0)], "url string, visit_seq bigint")
    most = float("inf") if max_pages is None else max_pages
    visited, n = _Visited(spark), min(1, most)
    if n:
        visited.add(level)
    while 0 < n < most:
        named = keep(edges.join(level, "url").groupBy("link").agg(F.min(F.struct("visit_seq", "place")).alias("_first")), "named")
        met = named.agg(F.count("*").alias("n"), F.collect_set(_bucket("link")).alias("buckets")).first()  # at most BUCKETS
        if not met["n"]:
            break
        fresh = named.join(visited.known(named, met["n"], met["buckets"]), "link", "left_anti")
        numbered = with_positions(fresh.select(F.col("link").alias("url"), F.col("_first.visit_seq").alias("_by"), F.col("_first.place").alias("_place")), ["_by", "_place", "url"], "_rank")
        numbered = numbered if max_pages is None else numbered.filter(F.col("_rank") < max_pages - n)
        level, more = visited.add(numbered.select("url", (F.col("_rank") + n).alias("visit_seq")))
        if not more:
            break
        n += more  # what a level leaves out is beyond max_pages, so it is never reached
    return visited.rows()


def crawl(spark: SparkSession, web: DataFrame, seed: str, max_pages: int | None = MAX_PAGES, includes: list[str] = (), crawl_excludes: list[str] | None = None, index_excludes: list[str] | None = None, sizes: ChunkSizes = ChunkSizes(), generic: list[str] | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(parents with pid, children with doc and pid, site name) of what is reached from the seed in web (url, body).

    A page that web doesn't have is visited and gives nothing, as a failed fetch does. Code hosts' text files are looked
    up under the URL that serves them raw.
    """
    crawl_excludes = urls.CRAWL_EXCLUDES if crawl_excludes is None else crawl_excludes
    index_excludes = urls.INDEX_EXCLUDES if index_excludes is None else index_excludes
    one = spark.range(1).select(urls.normalise(F.lit(seed)).alias("seed"), urls.auto_prefix(F.lit(seed)).alias("prefix"), urls.origin(F.lit(seed)).alias("origin")).first()
    read = keep(read_pages(web, generic=generic), "pages")
    scope = urls.in_scope(F.col("link"), one["prefix"], one["origin"], list(includes), crawl_excludes)
    links = read.select("url", F.posexplode("links").alias("place", "link"))
    visited = keep(walk(spark, links, one["seed"], max_pages, scope), "visited")
    site = visited.filter("visit_seq = 0").join(read, "url").select("site_title").first()
    pages = visited.join(read, "url").filter(~urls.matches(F.col("url"), index_excludes) & F.col("sections").isNotNull())
    parent = keep(number_parents(parents(pages, "visit_seq", sizes=sizes), "visit_seq"), "parents")
    child = number_children(children(parent, sizes).drop("visit_seq"))
    return parent.drop("visit_seq"), child, site["site_title"] if site else DEFAULT_SITE
