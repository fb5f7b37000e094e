"""The page cache as a data source, and the registry."""

import importlib.metadata
import os
import types

import pytest
from pyspark.sql import functions as F

from corvane.operators import facets
from corvane.session import shared_path
from corvane.sources import cachesource, registry


def rows(n):
    return [(f"https://x.org/{i}", None if i % 3 else f"e{i}", None, float(i), f"s{i}", f"body {i} é" * (i % 50), None) for i in range(n)]


@pytest.fixture
def cache(spark):
    cachesource.register(spark)
    path = shared_path(spark, "cache")
    spark.createDataFrame([*rows(300), (None, None, None, 1.0, None, "x", None)], cachesource._SCHEMA).repartition(5).write.format(cachesource.NAME).mode("append").option("path", path).save()
    return path


def load(spark, path):
    return spark.read.format(cachesource.NAME).option("path", path).load()


def test_cache_comes_back(spark, cache):
    got = sorted(tuple(r)[:6] for r in load(spark, cache).collect())
    assert got == sorted(r[:6] for r in rows(300))
    assert {(r["url"], r["shelf"]) for r in load(spark, cache).collect()} == {(r[0], cachesource.shelf_of(r[0])) for r in rows(300)}
    assert "_tasks" not in os.listdir(cache.removeprefix("file://")) or not os.listdir(cache.removeprefix("file://") + "/_tasks")


def test_filters_are_pushed(spark, cache):
    wanted = [f"https://x.org/{i}" for i in (3, 50, 299, 1000)]
    some = load(spark, cache).filter(F.col("url").isin(wanted))
    assert {r["url"] for r in some.collect()} == set(wanted[:3])
    reader = cachesource.CacheReader(cache)
    left = list(reader.pushFilters([cachesource.In(("url",), tuple(wanted)), cachesource.EqualTo(("etag",), "e3")]))
    assert len(left) == 1 and reader.shelves == {cachesource.shelf_of(u) for u in wanted}
    assert sum(len(p.names) for p in reader.partitions()) == len(reader.shelves)
    assert some.rdd.getNumPartitions() == 1 and load(spark, cache).rdd.getNumPartitions() == 16
    one = cachesource.shelf_of(wanted[0])
    assert {r["url"] for r in load(spark, cache).filter(F.col("shelf") == one).collect()} == {r[0] for r in rows(300) if cachesource.shelf_of(r[0]) == one}
    assert load(spark, cache).filter("url = 'https://x.org/3' and etag = 'e3'").count() == 1
    assert load(spark, cache).filter("url = 'https://x.org/3' and url = 'https://x.org/4'").count() == 0


def test_overwrite_and_abort(spark, cache):
    broken = spark.range(4).select(F.concat(F.lit("u"), "id").alias("url"), *[F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified")], F.when(F.col("id") < 3, 1.0).otherwise(F.raise_error(F.lit("no"))).alias("fetched_at"), *[F.lit("z").alias(c) for c in ("sha256", "body", "shelf")])
    with pytest.raises(Exception, match="no"):
        broken.write.format(cachesource.NAME).mode("append").option("path", cache).save()
    assert load(spark, cache).count() == 300
    spark.createDataFrame(rows(2), cachesource._SCHEMA).write.format(cachesource.NAME).mode("overwrite").option("path", cache).save()
    assert load(spark, cache).count() == 2


LOCAL = """
from pyspark.sql.datasource import DataSource, DataSourceReader

class Reader(DataSourceReader):
    def read(self, partition):
        yield ("{name}", helper())

def helper():
    return 7

class Local(DataSource):
    @classmethod
    def name(cls):
        return "{name}"
    def schema(self):
        return "name string, n int"
    def reader(self, schema):
        return Reader()
"""


def test_registry_finds_by_each_way(spark, tmp_path, monkeypatch):
    os.makedirs(tmp_path / "sources")
    (tmp_path / "sources" / "mine.py").write_text(LOCAL.replace("{name}", "mine"))
    (tmp_path / "sources" / "_hidden.py").write_text("raise RuntimeError")
    (tmp_path / "sources" / "cache.py").write_text(LOCAL.replace("{name}", "both"))
    folder = str(tmp_path)
    assert spark.read.format(registry.use(spark, registry.SOURCE, "mine", folder)).load().collect() == [("mine", 7)]
    installed = registry.find(registry.SOURCE, "mine", folder)
    loaded = []
    points = [types.SimpleNamespace(name=n, load=lambda n=n: loaded.append(n) or type("Theirs", (installed,), {"name": classmethod(lambda cls, n=n: n)})) for n in ("theirs", "both", "other")]
    monkeypatch.setattr(importlib.metadata, "entry_points", lambda group: points if group == "corvane.sources" else [])
    assert spark.read.format(registry.use(spark, registry.SOURCE, "theirs")).load().first()["n"] == 7 and loaded == ["theirs"]
    assert registry.find(registry.SOURCE, "both", folder).__name__ == "Local" and registry.find(registry.SOURCE, "both").__name__ == "Theirs"
    assert registry.find(registry.ADAPTER, cachesource.NAME) is cachesource.CacheSource
    assert registry.names(registry.SOURCE, folder) == ["both", cachesource.NAME, "mine", "other", "theirs"]
    with pytest.raises(LookupError, match="mine"):
        registry.find(registry.SOURCE, "none", folder)


def test_facets_of_levels_and_buckets(spark):
    """Documents on both sides of a bitmap's border, without a number, without a path."""
    docs = [(0, ["a", "b"], ["cat"]), (32767, ["a"], ["cat", "dog"]), (32768, ["a", "b"], ["dog"]), (70000, [], ["cat"]), (5, None, ["cat"]), (None, ["a"], ["cat"]), (9, ["c", "b", "x"], ["bird"])]
    df = spark.createDataFrame(docs, "doc bigint, categories array<string>, terms array<string>")
    queries = spark.createDataFrame([(1, "cat"), (2, "Dog cat cat"), (3, "none"), (4, None), (5, "bird!")], "query_id int, text string")
    got = facets.facet_counts(facets.hit_bitmaps(queries, df), facets.facet_bitmaps(df))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a", 2), (1, 2, "a/b", 1), (2, 1, "a", 3), (2, 2, "a/b", 2), (5, 1, "c", 1), (5, 2, "c/b", 1), (5, 3, "c/b/x", 1)]
