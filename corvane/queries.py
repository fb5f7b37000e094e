"""Named queries over the driver's tables, one or more for each operator, and the same in SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import urls, vectors
from .functions.text import tokens
from .operators import bm25, cache, calibration, chunking, crawl, dedup, embedding, facets, keywords, metadata, pages, postings, retrieval
from .operators.segments import Segments
from .plans.build import build_index
from .session import keep, shared_path, spread
from .sources import cachesource, files
from .streaming import states

DOC_BASE = "https://github.com/org/repo/blob/main/docs/doc-"
NEAR = 0.3  # the test vectors have no pair above the default threshold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.read_texts(files.text_documents(table(spark, sf_dir, "documents"), DOC_BASE))


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parents(_texts(spark, sf_dir), "doc_id")


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.children(_parents(spark, sf_dir).withColumnRenamed("local_pid", "pid"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as BM25 sees them: their whole text, one row each."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("doc"), tokens(F.coalesce("text", F.lit(""))).alias("terms"))


def _once(spark: SparkSession, sf_dir: str) -> bool:
    """Whether each document has an id of its own."""
    return bm25.unique(table(spark, sf_dir, "documents"), "doc_id")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.normalise(u).alias("normalised"), urls.origin(u).alias("origin"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.kind(u).alias("kind"), urls.is_git_host(u).alias("git_host"), urls.is_portal(u).alias("portal"))


def url_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages against the scope of their own page, with and without includes."""
    links = pages.read_pages(files.page_table(spark, f"{sf_dir}/pages.parquet")).select("url", F.posexplode("links").alias("place", "link"))
    prefix, origin = urls.auto_prefix(F.col("url")), urls.origin(F.col("url"))
    near = urls.in_scope(F.col("link"), prefix, origin, [], urls.CRAWL_EXCLUDES)
    wide = urls.in_scope(F.col("link"), prefix, origin, [r"example\.(com|org)/"], urls.CRAWL_EXCLUDES)
    return links.select("url", F.col("place").cast("bigint").alias("place"), "link", near.alias("in_scope"), wide.alias("in_wide_scope"), urls.is_asset(F.col("link")).alias("asset"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of URL that a rule is about, made from document ids."""
    tails = ["/Search", "/Search/?q=1", "/issues/4", "/a.PDF", "/a.pdf/x", "/b.md?raw=1", "/tree/main", "/CategoryID=3", "/wiki/_edit", "/styles.css?v=2", "/TDClient/12/Help/KB"]
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://site"), (F.col("doc_id") % 7).cast("string"), F.lit(".example.org"), F.element_at(F.array(*map(F.lit, tails)), (F.col("doc_id") % len(tails) + 1).cast("int"))).alias("url"))
    u = F.col("url")
    return d.select("doc_id", "url", urls.is_asset(u).alias("asset"), urls.matches(u, urls.CRAWL_EXCLUDES).alias("crawl_excluded"), urls.matches(u, urls.INDEX_EXCLUDES).alias("index_excluded"), urls.auto_prefix(u).alias("auto_prefix"))


def git_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return files.text_documents(table(spark, sf_dir, "documents"), DOC_BASE).select("doc_id", urls.is_git_text(u).alias("git_text"), urls.git_raw_url(u).alias("raw_url"), urls.blob_title(u).alias("title"), urls.cache_path(u).alias("cache_path"), urls.stable_id(u, F.lit("Doc")).alias("stable_id"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.read_pages(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body")))
    return found.select("page_id", F.col("site_title").alias("title"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.read_pages(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body")))
    return found.select("page_id", F.posexplode("links").alias("place", "link")).withColumn("place", F.col("place").cast("bigint"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.read_pages(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body")), generic=["article"])
    return found.select("page_id", "title", F.posexplode("sections").alias("place", "s")).select("page_id", "title", F.col("place").cast("bigint").alias("place"), "s.heading", "s.text")


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every kind that has a rule of its own for where content is, made from the titles of pages."""
    said, i = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("page_id").cast("string")
    boxes = ['<div id="divMainContent">', '<div class="wide markdown-body">', '<div class="markdown-body">', '<div class="markdown-body">', "", "<main>"]
    links = ["https://corp.teamdynamix.com/TDClient/12/Portal/KB/ArticleDet?ID=", "https://github.com/org/repo/wiki/Page-", "https://github.com/org/repo/releases/tag/v", "https://github.com/org/repo/issues/", "https://github.com/org/repo/blob/main/docs/page-", "https://docs.example.org/p/"]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % 6 + 1).cast("int"))
    markdown = F.col("page_id") % 6 == 4
    page = F.concat(F.lit("<html><head><title>Article - "), said, F.lit("</title></head><body><nav>menu</nav>"), pick(boxes), F.lit("<p>Intro of page "), i, F.lit(".</p><h2>First "), said, F.lit("</h2><p>"), said, F.lit('</p><div class="breadcrumb">no</div><p>End.</p><h3>Second</h3><p>Last words.</p></div></main><footer>foot</footer></body></html>'))
    text = F.concat(F.lit("# Page "), i, F.lit("\n\nIntro of page "), i, F.lit(".\n\n## First\n\nSome words.\n\n### Second\n\nLast words.\n"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(pick(links), i, F.when(markdown, ".md").otherwise("")).alias("url"), F.when(markdown, text).otherwise(page).alias("body"))


def content_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with headings of portal, wiki, release, other code-host, Markdown and generic pages; those without content have one row of nulls."""
    found = pages.read_pages(_branches(spark, sf_dir))
    return found.select("page_id", "site_title", "title", F.posexplode_outer("sections").alias("place", "s")).select("page_id", "site_title", "title", F.col("place").cast("bigint").alias("place"), "s.heading", "s.text")


def section_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_sections in SQL: a table function joined laterally."""
    pages.register_sections(spark)
    pages.prepared(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body")), generic=["article"]).createOrReplaceTempView("corvane_prepared_pages")
    return spark.sql("SELECT p.page_id, s.place, s.heading, s.text FROM corvane_prepared_pages p, LATERAL page_sections(p.url, p.body, p.form, p.selectors, p.noise, p.need_text) s")


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.read_pages(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body")), generic=["article"])
    return chunking.children(chunking.parents(found, "page_id").withColumnRenamed("local_pid", "pid"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as Markdown: their first line a heading, their second a section's."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(DOC_BASE), F.col("doc_id").cast("string"), F.lit(".md")).alias("url"), F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n\n## Body\n\n"), F.coalesce("text", F.lit(""))).alias("body"))
    return pages.read_pages(d).select("doc_id", "title", F.posexplode("sections").alias("place", "s")).select("doc_id", "title", F.col("place").cast("bigint").alias("place"), "s.heading", F.length("s.text").cast("bigint").alias("chars"))


def parent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(spark, sf_dir).select("doc_id", "local_pid", "t", "x", "u", "host", "kind", "weight")


def child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _children(spark, sf_dir).select("doc_id", "pid", "ordinal", "x")


def chunk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global parent ids over all documents in order."""
    return chunking.number_parents(_parents(spark, sf_dir), "doc_id").select("pid", "doc_id", F.sha2("x", 256).alias("x_sha256"))


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("doc", F.array_join("terms", " ").alias("terms"))


def bm25_doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.doc_lengths(_terms(spark, sf_dir))


def bm25_document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.token_frequencies(_terms(spark, sf_dir))


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_frequencies(_terms(spark, sf_dir), _once(spark, sf_dir))


def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.statistics(bm25.doc_lengths(_terms(spark, sf_dir)))


def bm25_child_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over child chunks, headings included: what an index holds. Each row is a chunk, also where documents repeat an id."""
    return bm25.row_frequencies(bm25.doc_tokens(_children(spark, sf_dir), "doc_id"))


def quantised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.quantise(F.col("embedding")).alias("q"))
    return v.select("vec_id", F.posexplode("q").alias("i", "value")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("value").cast("bigint").alias("value"))


def near_duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_edges(table(spark, sf_dir, "embeddings"), NEAR, "vec_id")


def greedy_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_near_duplicates(table(spark, sf_dir, "embeddings"), NEAR, "vec_id").select("vec_id")


def compacted_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as children of parents of four; what a collapse leaves, renumbered."""
    v = table(spark, sf_dir, "embeddings").withColumn("pid", F.floor(F.col("vec_id") / 4))
    parents = v.select("pid").distinct()
    left = dedup.drop_near_duplicates(v, NEAR, "vec_id")
    _, moved = dedup.compact_parents(parents, left)
    return moved.select("vec_id", "pid")


def calibration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    stats = calibration.calibrate(v, v.count(), pos="vec_id")
    return stats.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "sample_size")


def calibration_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row in the sample, so that SQL can say the same at any size."""
    v = table(spark, sf_dir, "embeddings")
    n = v.count()
    stats = calibration.calibrate(v, n, sample=n, pos="vec_id")
    return stats.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "sample_size")


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _children(spark, sf_dir).select("doc_id", "pid", "ordinal", "t", "x")
    e = embedding.embed(chunks, embedding.hash_embedder, F.col("x"))
    return e.select("doc_id", "pid", "ordinal", F.size("embedding").cast("bigint").alias("dims"), F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


def _script(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests, cache and responses that take every branch, made from pages."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit("|"), F.col("url")).alias("url"), "html")
    m = F.col("page_id") % 8
    n = F.lit(None).cast("string")
    requests = p.select("page_id", "url", (m != 6).alias("expect_html"))
    held = p.filter(m.isin(1, 2, 3, 4, 5)).select("url", F.when(m != 4, F.concat(F.lit('W/"'), "page_id", F.lit('"'))).alias("etag"), F.when(m == 4, "Mon, 05 Jan 2026 10:00:00 GMT").alias("last_modified"), F.lit(1000.0).alias("fetched_at"), F.sha2("html", 256).alias("sha256"), F.when(m != 2, F.col("html")).alias("body"))
    first = p.select("url", F.lit(1).alias("call_no"), F.when(m.isin(1, 2), 304).when(m == 3, F.lit(None)).when(m == 5, 500).otherwise(200).alias("status"), F.when(m == 7, "application/pdf").when(m == 6, "text/plain; charset=utf-8").otherwise("text/html; charset=utf-8").alias("content_type"), F.when(m == 0, F.lit('"new"')).alias("etag"), n.alias("last_modified"), F.concat("html", F.lit("!")).alias("body"))
    second = p.filter(m == 2).select("url", F.lit(2).alias("call_no"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit('"again"').alias("etag"), n.alias("last_modified"), F.concat("html", F.lit("?")).alias("body"))
    return requests, held, first.unionByName(second)


def cache_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, held, responses = _script(spark, sf_dir)
    found = cache.revalidate(requests.select("url", "expect_html"), held, responses, 2000.0)
    return found.select("url", "conditional", "outcome", F.sha2("body", 256).alias("body_sha256"), "etag", "last_modified", "fetched_at", "sha256")


def cache_after_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, held, responses = _script(spark, sf_dir)
    found = cache.revalidate(requests.select("url", "expect_html"), held, responses, 2000.0)
    return cache.updated_cache(held, found).select("url", "etag", "fetched_at", "sha256")


def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cache_after_fetch, by a stream of answers with a state for each URL."""
    requests, held, responses = _script(spark, sf_dir)
    answer = lambda n, name: responses.filter(F.col("call_no") == n).select("url", F.struct("status", "content_type", "etag", "last_modified", "body").alias(name))
    events = requests.join(answer(1, "first"), "url", "left").join(answer(2, "second"), "url", "left").select("url", F.lit(1).cast("bigint").alias("seq"), "expect_html", F.lit(2000.0).alias("now"), "first", "second")
    found = states.replay(events, held, shared_path(spark, "states"))
    return cache.updated_cache(held, found).select("url", "etag", "fetched_at", "sha256")


def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta build: every third page has another body than the cache."""
    p = table(spark, sf_dir, "pages")
    held = p.select("url", F.sha2("html", 256).alias("sha256"))
    now = p.select("page_id", "url", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("+"))).otherwise(F.col("html")).alias("body"))
    return cache.changed(now, held).select("page_id")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three links for each page of a synthetic site."""
    rows = table(spark, sf_dir, "pages")
    p = rows.select(F.col("page_id").alias("i"), F.lit(rows.count()).alias("n"))
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    to = F.array((F.col("i") * 2 + 1) % F.col("n"), (F.col("i") * 7 + 3) % F.col("n"), (F.col("i") * 3 + 2) % F.col("n"))
    return p.select(name(F.col("i")).alias("url"), F.posexplode(F.transform(to, name)).alias("place", "link"))


def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.walk(spark, keep(_graph(spark, sf_dir), "graph"), "p0", max_pages=None)


def crawl_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.walk(spark, keep(_graph(spark, sf_dir), "graph"), "p0", 17)


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one site, each linking the next ones, with their own articles."""
    p = table(spark, sf_dir, "pages")
    url = F.concat(F.lit("https://docs.example.org/p/"), F.col("page_id").cast("string"))
    more = F.concat(*[F.concat(F.lit('<a href="/p/'), (F.col("page_id") * k + 1).cast("string"), F.lit('">n</a>')) for k in (2, 3)])
    return p.select(url.alias("url"), F.concat("html", more).alias("body"))


def _whole_site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """Without a limit: links to pages that the site doesn't have are visits too, so no count of rows bounds them."""
    return crawl.crawl(spark, _site(spark, sf_dir), "https://docs.example.org/p/1", max_pages=None, generic=["article"])


def site_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk, extraction and chunking of a whole site."""
    parents, children, _ = _whole_site(spark, sf_dir)
    return children.join(parents.select("pid", F.length("x").cast("bigint").alias("parent_chars")), "pid").select("doc", "pid", "t", "u", F.length("x").cast("bigint").alias("chars"), "parent_chars")


def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an index built from a site, end to end."""
    parents, children, site = _whole_site(spark, sf_dir)
    index = build_index(parents, children, site, text=F.col("x"))
    n = index.children.agg(F.count("*").alias("chunks"), F.countDistinct("u").alias("sources"))
    more = index.parents.agg(F.count("*").alias("parents"))
    df = bm25.document_frequencies(index.tf).agg(F.count("*").alias("terms"))
    return n.join(more, F.lit(True)).join(df, F.lit(True)).select("chunks", "sources", "parents", "terms", F.lit(index.calibration["sampleSize"]).cast("bigint").alias("sample_size"), F.lit(index.site).alias("site"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 documents of each benchmark text."""
    terms = keep(_terms(spark, sf_dir), "terms")
    lengths = bm25.doc_lengths(terms)
    stats = bm25.statistics(lengths).first()
    if once := _once(spark, sf_dir):
        tf, df = bm25.term_frequencies(terms.withColumn("len", F.size("terms")), True, "len"), bm25.row_frequencies(terms)
    else:
        tf = bm25.term_frequencies(terms)
        df = bm25.document_frequencies(tf)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    scores = retrieval.bm25_scores(queries, tf, None if once else lengths, df, stats["docs"], stats["avg_doc_len"])
    return retrieval.top_k(scores.withColumn("score", F.round("score", 6)), 10)


def _block_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int, float]:
    terms = keep(_terms(spark, sf_dir), "terms")
    stats = bm25.statistics(bm25.doc_lengths(terms)).first()
    index = keep(postings.blocks(terms, stats["avg_doc_len"]), "posting-blocks")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index, queries, index.groupBy("term").agg(F.sum("n").alias("df")), stats["docs"], stats["avg_doc_len"]


def bm25_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_search over blocks of postings, most of which are skipped."""
    scores = postings.search(*_block_index(spark, sf_dir))
    return retrieval.top_k(scores.withColumn("score", F.round("score", 6)), 10)


def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term's postings over all blocks, and its longest block."""
    index, *_ = _block_index(spark, sf_dir)
    return index.groupBy("term").agg(F.sum("n").alias("postings"), F.min("first").alias("first"), F.max("last").alias("last"), (F.max("n") <= postings.BLOCK_DOCS).alias("bounded"))


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the documents that hold a term of a benchmark text are of each language, and of each language and source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.array(F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none"))).alias("categories"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return facets.facet_counts(facets.hit_bitmaps(queries, _terms(spark, sf_dir)), facets.facet_bitmaps(docs))


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to the page cache by its data source, and read from it."""
    cachesource.register(spark)
    path = shared_path(spark, "cache")
    url = F.concat(F.lit("https://docs.example.org/p/"), F.col("page_id").cast("string"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "pages").select(url.alias("url"), F.concat(F.lit('"'), "page_id", F.lit('"')).alias("etag"), none.alias("last_modified"), F.lit(1000.0).alias("fetched_at"), F.sha2("html", 256).alias("sha256"), F.col("html").alias("body"), none.alias("shelf"))
    rows.write.format(cachesource.NAME).mode("append").option("path", path).save()
    return spark.read.format(cachesource.NAME).option("path", path).load()


def cache_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cache, read back."""
    return _cached(spark, sf_dir).select("url", "etag", "sha256", F.sha2("body", 256).alias("body_sha256"), "shelf")


def cache_source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some pages by URL: only their shelves are opened."""
    wanted = [f"https://docs.example.org/p/{i}" for i in range(0, 60, 7)] + ["https://docs.example.org/none"]
    return _cached(spark, sf_dir).filter(F.col("url").isin(wanted)).select("url", "etag", F.sha2("body", 256).alias("body_sha256"))


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def cosine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 vectors, by position, of each hundredth vector."""
    scores = retrieval.cosine_scores(_query_vectors(spark, sf_dir), table(spark, sf_dir, "embeddings"), key="vec_id", best=10)
    return retrieval.top_k(scores.withColumn("score", F.round("score", 9)), 10)


def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of exact and int8 rankings."""
    rows = table(spark, sf_dir, "embeddings")
    exact = retrieval.top_k(retrieval.cosine_scores(_query_vectors(spark, sf_dir), rows, key="vec_id", best=10).withColumn("score", F.round("score", 9)), 10)
    low = rows.withColumn("embedding", vectors.dequantise(vectors.quantise(F.col("embedding"))))
    coarse = retrieval.top_k(retrieval.cosine_scores(_query_vectors(spark, sf_dir), low, key="vec_id", best=10).withColumn("score", F.round("score", 9)), 10)
    return retrieval.fuse(exact, coarse).select("query_id", "doc", F.round("score", 9).alias("score"))


def calibrated_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches whose nearest-other z-score is above -1."""
    v = table(spark, sf_dir, "embeddings")
    n = v.count()
    c = calibration.calibrate(v, n, sample=n, pos="vec_id").first()
    floor = c["mean"] - 1.001 * c["std"]  # below what z > -1 needs, whatever the rounding
    scores = retrieval.cosine_scores(_query_vectors(spark, sf_dir), v, key="vec_id", floor=floor).filter(F.col("query_id") != F.col("doc"))
    z = retrieval.z_score(F.col("score"), c["mean"], c["std"])
    return scores.withColumn("z", F.round(z, 4)).filter("z > -1").select("query_id", "doc", "z")


def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small to big: each child's parent."""
    p = _parents(spark, sf_dir).withColumnRenamed("local_pid", "pid")
    c = chunking.children(p)
    return c.select("doc_id", "pid", "ordinal").join(p.select("doc_id", "pid", F.sha2("x", 256).alias("parent_sha256")), ["doc_id", "pid"])


def parent_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metadata.describe(_parents(spark, sf_dir))
    return d.select("doc_id", "local_pid", "id", "source_type", "content_type", F.array_join("categories", "/").alias("categories"), "local")


def privacy_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metadata.privacy_flags(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("x")))
    return d.filter(F.size("privacy_flags") > 0).select("doc_id", F.array_join("privacy_flags", ",").alias("flags"))


def caption_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = files.captions(table(spark, sf_dir, "conversations"), "https://video.example.org/")
    return c.select("url", F.sha2("body", 256).alias("body_sha256"))


def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten keywords of each document."""
    return keywords.keywords(table(spark, sf_dir, "documents"))


def _three_versions(spark: SparkSession, sf_dir: str) -> Segments:
    """A site in three versions: pages come, change (once and back, once for good) and go."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.concat(F.lit("https://docs.example.org/p/"), F.col("page_id").cast("string")).alias("url"), F.col("html").alias("body"))
    m = lambda k: F.col("ord") % k
    said = lambda text: F.replace("body", F.lit("</article>"), F.lit(f"<p>{text}</p></article>"))
    held = Segments(spark, shared_path(spark, "segments"), generic=["article"])
    held.apply(p.filter(m(5) != 4))
    held.apply(p.filter(m(7) != 1).withColumn("body", F.when(m(3) == 0, said("This page was revised once, and that is all that happened to it.")).otherwise(F.col("body"))))
    held.apply(p.filter(m(11) != 2).withColumn("body", F.when(m(3) == 0, said("This page was revised again, now for good, in the third version.")).when(m(4) == 1, said("Another remark.")).otherwise(F.col("body"))))
    return held


def delta_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after two deltas, numbered as one that is built anew."""
    _, chunks = _three_versions(spark, sf_dir).compact()
    return chunks.select("doc", "pid", "u", F.sha2("x", 256).alias("x_sha256"), F.size("embedding").cast("bigint").alias("dims"))


def delta_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies after two deltas, by adding and taking away."""
    return _three_versions(spark, sf_dir).document_frequencies()


def delta_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each delta read and embedded."""
    return _three_versions(spark, sf_dir).history()


QUERIES = {f.__name__: f for f in (
    url_parts, url_scope, url_filters, git_files, page_titles, page_links, page_sections, page_chunks, markdown_sections, parent_chunks, child_chunks, chunk_positions,
    token_lists, bm25_doc_lengths, bm25_document_frequencies, bm25_postings, bm25_statistics, bm25_child_frequencies, quantised_vectors, near_duplicate_edges,
    greedy_near_duplicates, compacted_parents, calibration_stats, calibration_all, hash_embeddings, cache_revalidation, cache_after_fetch, changed_pages, crawl_order,
    crawl_limited, site_crawl, index_manifest, bm25_search, cosine_search, fused_search, calibrated_matches, parent_lookup, parent_metadata, privacy_review, caption_texts,
    document_keywords, delta_index, delta_terms, delta_history, bm25_block_search, posting_blocks, content_branches, section_lateral, facet_counts, cache_states, cache_source, cache_source_urls,
)}
