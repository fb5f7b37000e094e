"""The whole build: pages to an index, and its command line."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, calibration, dedup, embedding
from ..operators.crawl import crawl
from ..operators.positions import with_positions
from ..schemas import MAX_PAGES, NEAR_DUP_COSINE
from ..session import keep, local_session
from ..sinks.outputs import Index, write_container, write_parquet
from ..sources.files import page_table


def build_index(parents: DataFrame, children: DataFrame, site: str, make: Callable[[], embedding.Embedder] = embedding.hash_embedder, text=None, threshold: float = NEAR_DUP_COSINE) -> Index:
    """Embed children (doc, pid, ...) once, drop near duplicates, compact parents, gather statistics of what is left."""
    text = embedding.embed_text(F.col("t"), F.col("x")) if text is None else text
    vectors = keep(embedding.embed(children, make, text), "vectors")
    left = dedup.drop_near_duplicates(vectors, threshold, "doc")
    parents, moved = dedup.compact_parents(parents, left)
    final = keep(with_positions(moved.withColumnRenamed("doc", "_was"), ["_was"], "doc").drop("_was"), "children")
    terms = keep(bm25.doc_tokens(final), "terms")
    tf = keep(bm25.term_frequencies(terms), "tf")
    one = calibration.calibrate(final, final.count(), pos="doc").first()
    stats = {"mean": one["mean"], "std": one["std"], "sampleSize": one["sample_size"]}
    return Index(parents, final, tf, bm25.doc_lengths(terms), stats, site)


def build_from_pages(spark: SparkSession, web: DataFrame, seed: str, max_pages: int = MAX_PAGES, **more) -> Index:
    parents, children, site = crawl(spark, web, seed, max_pages, **more)
    return build_index(parents, children, site)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Build a search index from a table of fetched pages.")
    p.add_argument("--pages", required=True, help="Parquet table of pages (url, html)")
    p.add_argument("--url", required=True, help="where the walk starts")
    p.add_argument("--out", default="index.json", help="container file, or folder with --parquet")
    p.add_argument("--max-pages", type=int, default=MAX_PAGES)
    p.add_argument("--float32-vecs", action="store_true", help="vectors in single precision instead of signed bytes")
    p.add_argument("--parquet", action="store_true", help="tables instead of one file")
    a = p.parse_args(argv)
    spark = local_session()
    index = build_from_pages(spark, page_table(spark, a.pages), a.url, a.max_pages)
    if a.parquet:
        write_parquet(index, a.out)
    elif not write_container(index, a.out, a.float32_vecs):
        print("No chunks: nothing written.")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
