from collections import deque

import pytest
from pyspark.sql import functions as F

from corvane import queries
from corvane.operators import cache, crawl
from corvane.schemas import CACHE, RESPONSE
from corvane.session import shared_path
from corvane.sources import files
from corvane.streaming import updates


@pytest.fixture(scope="module")
def step(spark):
    def run(held, responses, expect_html=True, now=2000.0):
        requests = spark.createDataFrame([("u", expect_html)], "url string, expect_html boolean")
        c = spark.createDataFrame(held, CACHE)
        r = spark.createDataFrame(responses, RESPONSE)
        found = cache.revalidate(requests, c, r, now)
        sent = cache.conditional_headers(requests, c).first()
        return found.first(), {x["url"]: x for x in cache.updated_cache(c, found).collect()}, sent

    return run


HELD = ("u", 'W/"1"', "Mon", 1000.0, "old", "cached")
OTHER = ("v", None, None, 5.0, "s", "b")


def test_first_fetch_is_stored(step):
    r, after, sent = step([OTHER], [("u", 1, 200, "text/html; charset=utf-8", '"e"', "Tue", "<p>")])
    assert (r["outcome"], r["body"], r["conditional"]) == ("stored", "<p>", False) and sent["if_none_match"] is None
    assert (after["u"]["etag"], after["u"]["last_modified"], after["u"]["fetched_at"]) == ('"e"', "Tue", 2000.0) and after["v"]["sha256"] == "s"


def test_validators_are_sent_as_they_are(step):
    r, after, sent = step([HELD], [("u", 1, 304, None, None, None, None)])
    assert (sent["if_none_match"], sent["if_modified_since"]) == ('W/"1"', "Mon")
    assert (r["outcome"], r["body"]) == ("not_modified", "cached")
    assert (after["u"]["fetched_at"], after["u"]["sha256"]) == (2000.0, "old")


def test_lost_body_is_fetched_again(step):
    r, after, _ = step([(*HELD[:5], None)], [("u", 1, 304, None, None, None, None), ("u", 2, 200, "text/html", None, None, "new")])
    assert (r["outcome"], r["body"], after["u"]["etag"]) == ("stored", "new", None)


@pytest.mark.parametrize("response", [("u", 1, 200, "application/pdf", None, None, "%"), ("u", 1, None, None, None, None, None), ("u", 1, 500, "text/html", None, None, "e"), ("u", 1, 200, None, None, None, "x")])
def test_failures_change_nothing(step, response):
    r, after, _ = step([HELD], [response])
    assert r["body"] is None and tuple(after["u"][c] for c in ("url", "etag", "last_modified", "fetched_at", "sha256", "body")) == HELD


def test_unasked_304_is_no_page(step):
    r, after, _ = step([], [("u", 1, 304, None, None, None, None)])
    assert r["outcome"] == "mismatch" and after == {}


def test_raw_text_wants_plain(step):
    assert step([], [("u", 1, 200, "text/plain", None, None, "t")], expect_html=False)[0]["body"] == "t"
    assert step([], [("u", 1, 200, "text/html", None, None, "t")], expect_html=False)[0]["body"] is None


def test_metadata_file(spark, tmp_path):
    path = f"file://{tmp_path}/meta.json"
    assert files.cache_metadata(spark, path).count() == 0
    meta = spark.createDataFrame([HELD, OTHER], CACHE).drop("body")
    for _ in range(2):
        files.save_cache_metadata(meta, path)
    assert sorted(map(tuple, files.cache_metadata(spark, path).collect())) == sorted(map(tuple, meta.collect()))
    (tmp_path / "broken.json").write_text("{not json")
    assert files.cache_metadata(spark, f"file://{tmp_path}/broken.json").count() == 0


def fifo(links, seed, most):
    visited, queued, queue = [], {seed}, deque([seed])
    while queue and len(visited) < most:
        u = queue.popleft()
        visited.append(u)
        for v in links.get(u, []):
            if v not in queued and v != "out":
                queued.add(v)
                queue.append(v)
    return visited


@pytest.mark.parametrize("most", [0, 1, 7, 100])
def test_walk_is_first_in_first_out(spark, most):
    import numpy as np

    rng = np.random.default_rng(3)
    links = {f"p{i}": [f"p{j}" for j in rng.integers(0, 60, 3)] + (["out"] if i % 3 else ["p1", "missing"]) for i in range(40)}
    df = spark.createDataFrame([(u, k, v) for u, x in links.items() for k, v in enumerate(x)], "url string, place int, link string")
    got = crawl.walk(spark, df, "p0", most, F.col("link") != "out")
    assert [r["url"] for r in got.orderBy("visit_seq").collect()] == fifo(links, "p0", most)


def test_crawl_site(spark):
    words = "Words that fill a section up to the length that a parent chunk needs, and some more. "
    web = spark.createDataFrame(
        [
            ("https://a.org", f"<title>Home | Site</title><main><h2>In</h2><p>{words}</p><a href='/b'>b</a><a href='/tree/x'>t</a><a href='https://other.org/'>o</a><a href='/gone'>g</a></main>"),
            ("https://a.org/b", f"<title>B</title><main><h2>X</h2><p>{words}</p><h2>Y</h2><p>{words}!</p></main><a href='https://github.com/o/r/blob/main/x.md'>r</a>"),
            ("https://a.org/tree/x", f"<title>T</title><main>{words}</main><a href='/c'>c</a>"),
            ("https://a.org/c", f"<title>C</title><main>{words}</main>"),
        ],
        "url string, body string",
    )
    parents, children, site = crawl.crawl(spark, web, "https://a.org/#top")
    assert site == "Home"
    assert [(r["pid"], r["t"]) for r in parents.orderBy("pid").collect()] == [(0, "Home -- In"), (1, "B -- X"), (2, "B -- Y"), (3, "C")]  # /tree/ is walked, not indexed
    assert [(r["doc"], r["pid"]) for r in children.orderBy("doc").collect()] == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert crawl.crawl(spark, web.limit(0), "https://a.org")[2] == "Knowledge Base"


def test_streams(spark, tmp_path):
    feed, out = f"{tmp_path}/feed", f"{tmp_path}/cache"
    schema = "url string, body string, fetched_at double"

    def drain():
        q = updates.cache_writer(spark.readStream.schema(schema).parquet(feed), out, f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)

    spark.createDataFrame([("a", "1", 1.0), ("b", "1", 1.0), ("a", "2", 2.0)], schema).write.parquet(feed)
    drain()
    spark.createDataFrame([("a", "2", 3.0), ("b", "3", 3.0)], schema).write.mode("append").parquet(feed)
    drain()
    versions = spark.read.parquet(out)
    assert {(r["url"], r["body"]) for r in versions.collect()} == {("a", "2"), ("b", "1"), ("b", "3")}
    assert {(r["url"], r["body"]) for r in updates.latest(versions).collect()} == {("a", "2"), ("b", "3")}
    texts = spark.createDataFrame([(1, "https://a.org/x.txt", "word " * 100)], "doc_id int, url string, body string")
    assert updates.stream_children(texts).count() == 2
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_whole_crawls_have_no_limit(spark, tmp_path):
    """Over 10,000 pages are reached, and 400 that the site doesn't have come before them."""
    n = 10_200
    text = "<article><h1>T</h1><p>" + "some words of a page that is long enough to be a chunk " * 2 + "</p></article>"
    more = "".join(f'<a href="/gone/{i}">g</a>' for i in range(400)) + "".join(f'<a href="/p/{i}">n</a>' for i in range(n))
    html = F.concat(F.lit(text), F.when(F.col("id") == 1, F.lit(more)).otherwise(F.lit("")))
    spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    seen, queue = {0: 0}, deque([0])
    while queue:
        i = queue.popleft()
        for j in ((i * 2 + 1) % n, (i * 7 + 3) % n, (i * 3 + 2) % n):
            if j not in seen:
                seen[j] = len(seen)
                queue.append(j)
    assert len(seen) > 10_000
    assert {r["url"]: r["visit_seq"] for r in queries.crawl_order(spark, str(tmp_path)).collect()} == {f"p{i}": k for i, k in seen.items()}
    assert queries.site_crawl(spark, str(tmp_path)).select("u").distinct().count() == n
