"""Archives read back against a brute-force version, and by a plain reader of the standard."""

import base64
import glob
import hashlib
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.llm import queries, warc
from corvane.llm.shared import new_path

ODD = "WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:0>\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n"
HTML = [None, "", "<p>one</p>", "<p>one</p>", "é😀" * 50, "x" * 1000, "x" * 1000, "x" * 1001, ODD, ODD * 20, "\r\n", "\r\n\r\n", "\r\n\r\n", "a\r\n\r\nb" * 40, "WARC/1.1\r\nWARC-WARC/1.1\r\n", "W" * 64, "W" * 128, "tail\n", ""]
ROWS = [(i, f"https://example.org/{i}?q=a:%20b: c\r\nX: y" if i % 3 else None, h, "k", 1) for i, h in enumerate(HTML)]
SCHEMA = "page_id long, url string, html string, _record string, _size int"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows, min_bytes=0):
    first, out = {}, []
    for page, _, html, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (html or "").encode()
        seen = data in first and len(data) >= min_bytes
        out.append((page, len(data), digest(data), "revisit" if seen else "response", first[data] if seen else None))
        first.setdefault(data, page)
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((int(r["key"]) if r["key"] is not None else None, r["payload_bytes"], r["payload_digest"], r["record_type"], int(r["refers_to"]) if r["refers_to"] is not None else None) for r in df.collect()), key=str)


@pytest.mark.parametrize(("chunk", "min_bytes", "held"), [(1 << 20, 0, 200_000), (64, 0, 0), (7, 20, 200_000)])
def test_records_come_back(spark, chunk, min_bytes, held):
    path = new_path(spark, "archives")
    rows = [*ROWS, ROWS[5], ROWS[7]]  # equal rows
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), path, chunk=chunk, min_bytes=min_bytes, held_revisits=held)
    assert rows_of(warc.read(spark, path)) == brute(rows, min_bytes)
    parts = warc.payload_chunks(spark, path).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("number", "data"))).alias("p")).collect()
    assert all([x["number"] for x in r["p"]] == list(range(len(r["p"]))) and all(len(x["data"]) <= chunk for x in r["p"]) for r in parts)
    want = {(r[2] or "").encode() for r in rows}
    assert {b"".join(bytes(x["data"]) for x in r["p"]) for r in parts} == want


def records(data):
    """(fields, block) of each record of a file, as the standard tells."""
    while data:
        assert data.startswith(b"WARC/1.1\r\n")
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        data = rest[n + 4 :]


def test_files_follow_the_standard(spark):
    path = new_path(spark, "archives")
    archive = warc.write(spark.createDataFrame(ROWS, SCHEMA), path, chunk=100, date="2026-01-01T00:00:00Z")
    found = [r for f in glob.glob(f"{path.removeprefix('file://')}/{archive}/part-*") for r in records(open(f, "rb").read())]
    assert sum(f["WARC-Type"] == "warcinfo" for f, _ in found) == 1
    assert len({f["WARC-Record-ID"] for f, _ in found}) == len(found)
    whole = {f["WARC-Record-ID"]: {1: b} for f, b in found if f["WARC-Type"] == "response"}
    for f, b in found:
        assert f["WARC-Date"] == "2026-01-01T00:00:00Z"
        if f["WARC-Type"] == "continuation":
            whole[f["WARC-Segment-Origin-ID"]][int(f["WARC-Segment-Number"])] = b
        if f["WARC-Type"] == "revisit":
            assert f["WARC-Refers-To"] in whole or any(x["WARC-Record-ID"] == f["WARC-Refers-To"] for x, _ in found)
    for f, _ in found:
        if "WARC-Segment-Total-Length" in f:
            assert int(f["WARC-Segment-Total-Length"]) == sum(map(len, whole[f["WARC-Segment-Origin-ID"]].values()))
    bodies = {b"".join(p[i] for i in sorted(p)).partition(b"\r\n\r\n")[2] for p in whole.values()}
    assert bodies == {(h or "").encode() for h in HTML}


def test_splits_cut_anywhere(spark):
    rng = random.Random(1)
    rows = [(i, "u", rng.choice(HTML) or "" if i % 2 else "".join(rng.choice("WARC/1.\r\n-:") for _ in range(rng.randrange(400)))) for i in range(60)]
    path = new_path(spark, "archives")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, chunk=150)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("701", "4001"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert rows_of(warc.read(spark, path)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_two_archives_and_other_ids(spark):
    path = new_path(spark, "archives")
    for name in ("a b/%é", "c\r\nd"):
        warc.write(spark.createDataFrame([(name, bytearray(b"\xff\x00" * 40)), (None, None)], "name string, body binary"), path, "name", "body", None, chunk=30)
    got = warc.read(spark, path)
    assert sorted((r["key"], r["payload_bytes"]) for r in got.filter("key is not null").collect()) == [("a b/%é", 80), ("c\r\nd", 80)]
    assert got.filter("key is null").count() == 2


def test_damage_is_told(spark):
    path = new_path(spark, "archives")
    archive = warc.write(spark.createDataFrame([(1, "u", "hello world")], SCHEMA.rsplit(", ", 2)[0]), path)
    for f in glob.glob(f"{path.removeprefix('file://')}/{archive}/part-*"):
        data = open(f, "rb").read()
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if b"hello" in data:
            os.path.exists(crc) and os.remove(crc)
            open(f, "wb").write(data.replace(b"hello", b"jello"))
    with pytest.raises(PySparkException, match="digest differ"):
        warc.read(spark, path).collect()


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op12_warc_chunks(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_no_rows(spark):
    path = new_path(spark, "archives")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).count() == 0
