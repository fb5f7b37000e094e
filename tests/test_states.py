"""Revalidation as keyed state, in micro-batches, against the decisions taken one after the other."""

import random
import time

from corvane.schemas import CACHE
from corvane.session import shared_path
from corvane.streaming import states

ANSWERS = [
    (200, "text/html; charset=utf-8", '"a"', None, "new"), (200, "text/html", None, "Mon", None), (200, "text/plain", '"b"', None, "text"), (304, None, None, None, None), (404, "text/html", None, None, "gone"),
    (None, None, None, None, None), None, (200, "application/pdf", None, None, "%"), (200, "text/html", None, None, "no validators"),
]


def stream(spark, batches, cache, ttl_ms=None):
    states.prepare(spark)
    folder = shared_path(spark, "stream")
    for rows in batches:
        spark.createDataFrame(rows, states.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        time.sleep(1.1)  # files are taken in order of their times
    events = spark.readStream.schema(states.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    writer = states.outcomes(events, cache, ttl_ms).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    told = lambda: spark.read.schema(states.OUTCOME).parquet(f"{folder}/out").collect()
    if ttl_ms is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return told()
    query, until = writer.start(), time.time() + 90  # timers ask for batches without data, so it never ends by itself
    try:
        while time.time() < until:
            time.sleep(1)
            if query.exception():
                raise query.exception()
            if query.lastProgress and any(r["outcome"] == "expired" for r in told()) and len({r["seq"] for r in told()} - {None}) == sum(map(len, batches)):
                break
    finally:
        query.stop()
    return told()


def test_batches_are_decisions_in_turn(spark):
    rng = random.Random(2)
    held = [(f"u{i}", '"h"' if i % 3 else None, "Sun" if i % 3 == 0 and i else None, 1.0, "sha", "old" if i % 4 else None) for i in range(0, 16, 2)]
    batches = [[(f"u{rng.randrange(16)}" if rng.random() < 0.95 else None, 100 * b + n, rng.random() < 0.8, float(b), rng.choice(ANSWERS), rng.choice(ANSWERS)) for n in range(40)] for b in range(3)]
    row, want = {u: tuple(r) for u, *r in held}, []
    for url, seq, html, now, first, second in (e for b in batches for e in b):
        if url is not None:
            name = lambda a: a and dict(zip(("status", "content_type", "etag", "last_modified", "body"), a, strict=True))
            outcome, row[url] = states.decide(row.get(url), {"expect_html": html, "now": now, "first": name(first), "second": name(second)})
            want.append((url, seq, outcome, *(row[url] or (None,) * 5)))
    got = stream(spark, batches, spark.createDataFrame(held, CACHE))
    assert sorted(map(tuple, got)) == sorted(want)
    assert {w[2] for w in want} == {"stored", "not_modified", "failed", "mismatch"}


def test_unnamed_urls_are_forgotten(spark):
    stored = (200, "text/html", '"a"', None, "x")
    got = stream(spark, [[("u1", 1, True, 1.0, stored, None)], [("u2", 2, True, 2.0, stored, None)], [("u1", 3, True, 3.0, (304, None, None, None, None), None)]], None, ttl_ms=1)
    told = {(r["url"], r["outcome"]) for r in got}
    assert ("u1", "expired") in told and ("u1", "mismatch") in told  # nothing is held, so the 304 answers no condition
