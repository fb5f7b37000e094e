"""What a delta build moves, and pages that repeat a URL."""

from pyspark.sql import functions as F
from test_segments import site

from corvane.operators.segments import Segments
from corvane.session import shared_path


def test_postings_and_vectors_are_not_moved(spark):
    """Frequencies come from chunks, without a table of their own; positions are given before vectors are joined."""
    held = Segments(spark, shared_path(spark, "segments"))
    held.apply(site(spark, 0).filter("url <> 'https://x.org/1'"))
    chunks = held.live("chunks")
    want = chunks.select("url", "pid", "ordinal", F.explode("terms").alias("term")).groupBy("url", "pid", "ordinal", "term").agg(F.count("*").alias("tf"))
    found = held.live("tf")
    assert sorted(map(tuple, found.drop("segment").collect())) == sorted(map(tuple, want.collect())) != []
    assert not spark._jvm.java.io.File(held.path.removeprefix("file:") + "/tf").exists()
    plan = held.compact()[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("embedding") and "_part" not in [line for line in plan.splitlines() if "embedding" in line and "Relation" in line][0]


def test_repeated_pages_are_taken_once(spark):
    """Whichever body of a repeated URL is taken, its hash and its chunks are of the same one; pages without a URL have none."""
    body = lambda word: f"<title>T</title><main><p>{(word + ' ') * 30}</p></main>"
    web = spark.createDataFrame([("https://x.org/a", body("first"), 0), ("https://x.org/a", body("second"), 1), (None, body("none"), 2), ("https://x.org/b", body("other"), 3)], "url string, body string, ord bigint")
    held = Segments(spark, shared_path(spark, "segments"))
    held.apply(web)
    sha = held.table("pages").filter("url = 'https://x.org/a'").first()["sha256"]
    word = web.filter(F.sha2("body", 256) == sha).select(F.regexp_extract("body", "<p>(\\w+)", 1)).first()[0]
    rows = held.compact()[1].select("u", "x").collect()
    assert sorted(r["u"] for r in rows) == ["https://x.org/a", "https://x.org/b"] and rows[0]["x"].startswith(word)
    unique = Segments(spark, shared_path(spark, "segments"))
    unique.apply(web.filter("ord > 0"))
    assert unique.compact()[1].count() == 2
