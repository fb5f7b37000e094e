"""Every query with SQL gives what the SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from corvane import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_sql(spark, small, db, name):
    assert rows(queries.QUERIES[name](spark, small).toPandas()) == rows(db.sql(oracle.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE)))
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["term", "df"]
    assert set(queries.QUERIES) <= set(entry.queries()) and set(oracle.ORACLE) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, small):
    plan = queries.bm25_document_frequencies(spark, small)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
