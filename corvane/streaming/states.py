"""Revalidation as keyed state: a stream of answers, one cache row of state for each URL.

`updates.cache_writer` compares each micro-batch with all versions; here a URL's row (validators, body, content hash) is its
state, so a micro-batch touches the URLs it names only. An event is a request with the server's answer, and with the
repeated call's answer where there was one; what it does is the table in operators/cache. With `ttl_ms`, a URL that no
event has named for so long (processing time) is forgotten by a timer, and told as `expired`; such a query runs until it
is stopped, as timers ask for batches without data.

State is kept by the RocksDB store: `prepare` sets it for the session. Rows of a null URL are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ANSWER = "struct<status:int,content_type:string,etag:string,last_modified:string,body:string>"
EVENT = f"url string, seq bigint, expect_html boolean, now double, first {ANSWER}, second {ANSWER}"
_STATE = "etag string, last_modified string, fetched_at double, sha256 string, body string, seen bigint"
OUTCOME = "url string, seq bigint, outcome string, etag string, last_modified string, fetched_at double, sha256 string, body string"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def decide(held: tuple | None, event: Row) -> tuple[str, tuple | None]:
    """(outcome, cache row after it); a row is (etag, last_modified, fetched_at, sha256, body)."""
    answer = event["first"]
    if held and (held[0] or held[1]) and answer and answer["status"] == 304:
        if held[4] is not None:
            return "not_modified", (held[0], held[1], event["now"], held[3], held[4])
        answer = event["second"]
    if not answer or answer["status"] is None or answer["status"] >= 400:
        return "failed", held
    if ("text/html" if event["expect_html"] else "text/plain") not in (answer["content_type"] or ""):
        return "mismatch", held
    body = answer["body"] or ""
    return "stored", (answer["etag"], answer["last_modified"], event["now"], hashlib.sha256(body.encode()).hexdigest(), body)


def _told(url: str, seq: int | None, outcome: str, held: tuple | None) -> Row:
    names = ("etag", "last_modified", "fetched_at", "sha256", "body")
    return Row(url=url, seq=seq, outcome=outcome, **dict(zip(names, held or (None,) * len(names), strict=True)))


class Revalidation(StatefulProcessor):
    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, handle.getValueState("row", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        row = self.row.get()  # None for a URL without one; each call here is a round trip
        before = held = row and tuple(row)[:5]
        for event in sorted(rows, key=lambda e: e["seq"] or 0):
            outcome, held = decide(held, event)
            yield _told(key[0], event["seq"], outcome, held)
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        if held and (self.ttl or held != before):
            self.row.update((*held, now))
        if self.ttl:
            self.handle.registerTimer(now + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.row.exists() and self.row.get()[5] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():  # not named since
            self.row.clear()
            yield _told(key[0], None, "expired", None)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in [initialState] if isinstance(initialState, Row) else initialState:
            self.row.update((r["etag"], r["last_modified"], r["fetched_at"], r["sha256"], r["body"], 0))

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, cache: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """OUTCOME of each event of a stream (EVENT), in the order of seq for each URL; cache: rows to begin with."""
    first = None if cache is None else cache.filter("url is not null").select("url", "etag", "last_modified", "fetched_at", "sha256", "body").groupBy("url")
    mode = "processingTime" if ttl_ms else "none"
    return events.filter("url is not null").groupBy("url").transformWithState(Revalidation(ttl_ms), OUTCOME, "append", mode, initialState=first)


def replay(events: DataFrame, cache: DataFrame | None, folder: str, batches: int = 4) -> DataFrame:
    """The outcomes of a table of events that is streamed in so many batches under folder, as a table; a batch has files enough for all cores."""
    spark = events.sparkSession
    prepare(spark)
    files = max(1, spark.sparkContext.defaultParallelism)
    events.repartition(batches * files).write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/events")
    query = outcomes(stream, cache).writeStream.format("parquet").option("path", f"{folder}/outcomes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUTCOME).parquet(f"{folder}/outcomes")
