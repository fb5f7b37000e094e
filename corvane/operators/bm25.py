"""BM25 statistics of children: lengths, document frequencies, postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schemas import Bm25


def doc_tokens(child: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, terms): of heading and text, a missing heading being empty."""
    return child.select(F.col(doc).alias("doc"), tokens(F.concat(F.coalesce("t", F.lit("")), F.lit(" "), F.coalesce("x", F.lit("")))).alias("terms"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    """(doc, len): documents without a term stay, with 0."""
    return tokens.select("doc", F.size("terms").cast("bigint").alias("len"))


def counted(terms: Column) -> Column:
    """array<struct<term, tf>> of an array of terms, by term: sorted and counted within its row."""
    bind = lambda c, f: F.transform(F.array(c), f)[0]

    def counts(s: Column) -> Column:
        first = F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), F.struct(x.alias("term"), i.alias("at"))))
        runs = F.filter(first, lambda r: r.isNotNull())
        return bind(runs, lambda r: F.transform(r, lambda x, i: F.struct(x["term"].alias("term"), (F.coalesce(F.get(r, i + 1)["at"], F.size(s)) - x["at"]).cast("bigint").alias("tf"))))

    return bind(F.sort_array(terms), counts)


def unique(df: DataFrame, key: str) -> bool:
    """Whether no value of key is in two rows: a count over that column alone."""
    return df.groupBy(key).count().filter("count > 1").isEmpty()


def term_frequencies(tokens: DataFrame, once: bool = False, *more: str) -> DataFrame:
    """(term, doc, tf); once says that a doc is in one row, which then is counted within it, without a shuffle, and may bring columns along."""
    if not once:
        return tokens.select("doc", F.explode("terms").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"))
    # the outer form keeps the optimizer from counting once more in a filter of its own
    rows = tokens.select("doc", *more, F.explode_outer(counted(F.col("terms"))).alias("_t")).filter("_t is not null")
    return rows.select("_t.term", "doc", "_t.tf", *more)


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def row_terms(tokens: DataFrame) -> DataFrame:
    """(term): the different terms of each row."""
    return tokens.select(F.explode_outer(F.array_distinct("terms")).alias("term")).filter("term is not null")


def row_frequencies(tokens: DataFrame) -> DataFrame:
    """(term, df) where each row is a document: only a term and its count of each task are shuffled."""
    return document_frequencies(row_terms(tokens))


def token_frequencies(tokens: DataFrame) -> DataFrame:
    """(term, df) as document_frequencies has them, without a shuffle of postings: only rows that share a doc meet, all others are counted as they are."""
    again = F.broadcast(tokens.groupBy("doc").count().filter("count > 1").select(F.col("doc").alias("_doc")))
    same = F.col("doc").eqNullSafe(F.col("_doc"))
    together = term_frequencies(tokens.join(again, same, "left_semi")).select("term")
    return document_frequencies(row_terms(tokens.join(again, same, "left_anti")).unionByName(together))


def posting_lists(tf: DataFrame) -> DataFrame:
    """(term, postings array<struct<doc,tf>>) in document order: the sink's form; analyses use the flat table."""
    return tf.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc", "tf"))).alias("postings"))


def statistics(lengths: DataFrame, p: Bm25 = Bm25()) -> DataFrame:
    return lengths.agg(F.count("*").alias("docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_doc_len")).select(F.lit(p.k).alias("k"), F.lit(p.b).alias("b"), F.lit(p.d).alias("d"), "docs", "avg_doc_len")
