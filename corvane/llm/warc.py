"""WARC archives as chunked record tables.

A payload of any size is a stream of rows (record, number, data): `chunk_records` cuts it into chunks of at most `chunk`
bytes, in order, and carries its SHA-1 and SHA-256 from row to row, so that its last row has both digests. Everything
after that moves chunks, never whole records. `write` puts a record into a folder of archives:

    response   the first of the records of one payload (least id; nulls first), with the payload
    revisit    any other, of `min_bytes` or more: no payload, but WARC-Refers-To and the payload's digest

A payload of several chunks is a segmented record of the WARC 1.1 standard: its first chunk is segment 1, each other one a
`continuation` record. Spark's own writer makes the files, one chunk a row, so any store that Spark can write is good and
a lost task's half-written files are never committed.

Each record begins `WARC/1.1`, `WARC-Warcinfo-ID: <urn:uuid:...>` with a fresh id of the archive, which names its folder
too. These two lines part the records when `read` scans an archive in splits; no payload can hold them, as the id is
drawn after payloads are made. `read` hashes payloads again, chunk by chunk (whole ones in place, segments sorted by
record and number), and raises an error where a length or digest isn't what the headers say, or a revisit has no response.

Defined cases: null payload is an empty one; payloads are any bytes; equal rows are records of their own (one response,
the others revisit it); null ids, null or odd target URIs (line ends are escaped) are kept; other columns are ignored; an
empty table gives an archive with its warcinfo record only.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage

CHUNK = 1 << 20
#: Revisits up to which the writer looks them up in memory (60 MB at most); beyond, chunks are joined with them by record.
HELD_REVISITS = 200_000

_END, _CRLF = "\r\n\r\n", "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 (RFC 4648) of a digest of a multiple of 40 bits, from its hexadecimal form."""
    part = lambda i: F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in (1, 11, 21, 31)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds _size, _sha1 and _sha256 to each record's last chunk; a record's chunks come in order. Columns: _record, _last, _data, then others."""
    sha1, sha256, size, record = hashlib.sha1(), hashlib.sha256(), 0, None
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for name, last, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if name != record:
                sha1, sha256, size, record = hashlib.sha1(), hashlib.sha256(), 0, name
            part = data.as_buffer()
            sha1.update(part)
            sha256.update(part)
            size += len(part)
            for values, value in zip(out, (size, _base32(sha1.digest()), sha256.digest()) if last else (None,) * 3, strict=True):
                values.append(value)
        arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "_size", "_sha1", "_sha256"])


_DIGESTS = "_size long, _sha1 string, _sha256 binary"


def chunk_records(rows: DataFrame, id_col: str, payload_col: str, uri_col: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Rows (_record, _last, _data, _id, _uri, _number) of each payload, with _size, _sha1 and _sha256 on its last one."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    held = rows.select(F.expr("uuid()").alias("_record"), F.col(id_col).alias("_id"), uri.alias("_uri"), payload.alias("_payload"))
    last = F.greatest(F.floor((F.octet_length("_payload") - 1) / chunk), F.lit(0)).cast("int")
    held = held.withColumn("_n", last).select("*", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_number"))
    cut = held.select("_record", (F.col("_number") == F.col("_n")).alias("_last"), F.substring("_payload", F.col("_number") * chunk + 1, F.lit(chunk)).alias("_data"), "_id", "_uri", "_number")
    kind = dict(cut.dtypes)["_id"]
    return cut.mapInArrow(_carried, f"_record string, _last boolean, _data binary, _id {kind}, _uri string, _number int, {_DIGESTS}")


def revisits(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(_record, _first, _first_id) of each record whose payload another record has as response."""
    records = chunks.filter("_last").select("_record", "_id", "_size", "_sha256")
    first = F.min(F.struct("_id", "_record")).alias("_f")
    groups = records.filter(F.col("_size") >= min_bytes).groupBy("_sha256").agg(first, F.count("*").alias("_n")).filter("_n > 1").select("_sha256", F.col("_f._record").alias("_first"), F.col("_f._id").alias("_first_id"))
    return records.join(groups, "_sha256").filter(F.col("_record") != F.col("_first")).select("_record", "_first", "_first_id")


def _field(name: str, value: Column | str) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(_CRLF)), F.lit(""))


def _urn(value: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), value, F.lit(">"))


def _boundary(archive: str) -> str:
    return f"WARC/1.1{_CRLF}WARC-Warcinfo-ID: <urn:uuid:{archive}>{_CRLF}"


def _lines(chunks: DataFrame, archive: str, date: Column) -> DataFrame:
    """A record for each chunk of a response, one for each revisit; what the text writer adds to a row ends it."""
    revisit, whole = F.col("_first").isNotNull(), F.col("_last") & (F.col("_number") == 0)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8"), F.coalesce(F.concat(F.lit(f"{_CRLF}Content-Length: "), F.col("_size").cast("string")), F.lit("")), F.lit(_END)).cast("binary")
    block = F.when(revisit, http).when(F.col("_number") == 0, F.concat(http, F.col("_data"))).otherwise(F.col("_data"))
    first = F.col("_number") == 0
    key = lambda c: F.url_encode(F.col(c).cast("string"))
    part = F.regexp_replace(F.md5(F.concat_ws("/", "_record", F.col("_number").cast("string")).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    head = F.concat(
        F.lit(_boundary(archive)),
        _field("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        _field("WARC-Record-ID", _urn(F.when(first, F.col("_record")).otherwise(part))),
        _field("WARC-Date", date),
        _field("WARC-Target-URI", F.replace(F.replace("_uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _field("WARC-Payload-Digest", F.when(F.col("_last"), F.concat(F.lit("sha1:"), "_sha1"))),
        _field("WARC-Profile", F.when(revisit, _PROFILE)),
        _field("WARC-Refers-To", _urn(F.col("_first"))),
        _field("WARC-Segment-Number", F.when(~revisit & ~whole, (F.col("_number") + 1).cast("string"))),
        _field("WARC-Segment-Origin-ID", F.when(~first, _urn(F.col("_record")))),
        _field("WARC-Segment-Total-Length", F.when(~first & F.col("_last"), (F.col("_size") + F.lit(len(_PLAIN))).cast("string"))),
        _field("X-Record-Key", F.when(first, key("_id"))),
        _field("X-Refers-To-Key", key("_first_id")),
        _field("Content-Type", F.when(first, "application/http; msgtype=response")),
        _field("Content-Length", F.octet_length("_block").cast("string")),
        F.lit(_CRLF),
    )
    rows = chunks.filter(~revisit | F.col("_last")).withColumn("_number", F.when(revisit, 0).otherwise(F.col("_number"))).withColumn("_block", block)
    return rows.select(F.concat(head.cast("binary"), F.col("_block"), F.lit(_CRLF).cast("binary")).cast("string").alias("value"))


#: The HTTP header of a segmented response: its length isn't known when segment 1 is written, so it has none.
_PLAIN = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_END}"


def write(rows: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", min_bytes: int = 0, chunk: int = CHUNK, date: str | None = None, held_revisits: int = HELD_REVISITS) -> str:
    """Write rows as one archive under path and return its id. date: the records' WARC-Date, now if None."""
    spark, archive = rows.sparkSession, str(uuid.uuid4())
    chunks = stage(chunk_records(rows, id_col, payload_col, uri_col, chunk), "record-chunks")
    again = stage(revisits(chunks, min_bytes), "revisits")
    joined = chunks.join(F.broadcast(again) if again.count() <= held_revisits else again, "_record", "left")
    said = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    about = "software: corvane\r\nformat: WARC File Format 1.1\r\n"
    info = F.concat(F.lit(f"WARC/1.1{_CRLF}WARC-Type: warcinfo{_CRLF}WARC-Record-ID: <urn:uuid:{archive}>{_CRLF}WARC-Date: "), said, F.lit(f"{_CRLF}Content-Type: application/warc-fields{_CRLF}Content-Length: {len(about)}{_END}{about}{_CRLF}"))
    out = spark.range(1, numPartitions=1).select(info.alias("value")).unionByName(_lines(joined, archive, said))
    out.write.option("lineSep", _CRLF).text(f"{path}/{archive}")
    return archive


def archives(spark: SparkSession, path: str) -> list[str]:
    """Ids of the archives under path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def _after(data: Column, head: Column, n: Column | None = None) -> Column:
    """Bytes after a header and its blank line: n of them, or all."""
    at = F.octet_length(head) + len(_END) + 1
    return F.substring(data, at, n if n is not None else F.octet_length(data))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The records under path but warcinfo: _fields (map of header lines) and _payload (of its chunk; empty for a revisit), lengths checked."""
    out = None
    for archive in archives(spark, path):
        rows = spark.read.option("lineSep", _boundary(archive)).text(f"{path}/{archive}").filter("value like 'WARC-Type: %'")
        rows = rows.select(F.col("value").cast("binary").alias("_raw"), F.substring_index("value", _END, 1).alias("_head")).withColumn("_fields", F.str_to_map("_head", F.lit(_CRLF), F.lit(": ")))
        size = F.col("_fields")["Content-Length"].cast("int")
        whole = F.octet_length("_raw") == F.octet_length("_head") + 2 * len(_END) + size
        block = F.when(whole, _after(F.col("_raw"), F.col("_head"), size)).otherwise(F.raise_error(F.lit("a record isn't as long as its header says")))
        rows = rows.select("_fields", block.alias("_block"))
        http = F.substring_index(F.col("_block").cast("string"), _END, 1)
        payload = F.when(F.col("_fields")["WARC-Type"] == "continuation", F.col("_block")).otherwise(_after(F.col("_block"), http))
        rows = rows.select("_fields", payload.alias("_payload"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "_fields map<string,string>, _payload binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record under path: record_id, key (the id as a string), target_uri, record_type, payload_bytes, payload_digest (SHA-1 in base 32), refers_to (a revisit's response's key)."""
    f = F.col("_fields")
    name = lambda c: F.regexp_extract(f[c], "<urn:uuid:(.*)>", 1)
    segmented = f["WARC-Segment-Number"].isNotNull()
    rows = segments(spark, path).select(
        F.coalesce(name("WARC-Segment-Origin-ID"), name("WARC-Record-ID")).alias("_record"),
        F.coalesce(f["WARC-Segment-Number"].cast("int"), F.lit(1)).alias("_number"),
        (~segmented | f["WARC-Segment-Total-Length"].isNotNull()).alias("_last"),
        f["WARC-Type"].alias("_type"),
        F.url_decode(f["X-Record-Key"]).alias("_key"),
        f["WARC-Target-URI"].alias("_uri"),
        F.regexp_extract(f["WARC-Payload-Digest"], "sha1:(.*)", 1).alias("_said"),
        name("WARC-Refers-To").alias("_first"),
        F.url_decode(f["X-Refers-To-Key"]).alias("_first_key"),
        segmented.alias("_segmented"),
        F.when(segmented, F.col("_payload")).alias("_data"),
        F.when(~segmented, F.octet_length("_payload").cast("long")).alias("_size"),
        F.when(~segmented, base32_of_hex(F.sha1("_payload"))).alias("_sha1"),
    )
    rows = stage(rows, "archive-records")  # payloads of one chunk are done; only segments carry data
    parts = rows.filter("_segmented")
    told = parts.select("_record", "_last", "_data", "_number", "_said").repartition("_record").sortWithinPartitions("_record", "_number")
    told = told.mapInArrow(_carried, f"_record string, _last boolean, _data binary, _number int, _said string, {_DIGESTS}").filter("_last").select("_record", "_size", "_sha1", "_said")
    heads = parts.filter("_number = 1").select("_record", "_type", "_key", "_uri").join(told, "_record", "left")
    cols = ["_record", "_type", "_key", "_uri", "_size", "_sha1", "_said"]
    responses = rows.filter("not _segmented and _type = 'response'").select(*cols).unionByName(heads.select(*cols))
    wrong = F.raise_error(F.concat(F.lit("payload and digest differ in record "), F.col("_record")))
    responses = responses.withColumn("_sha1", F.when(F.col("_sha1").eqNullSafe(F.col("_said")), F.col("_sha1")).otherwise(wrong))
    known = responses.select(F.col("_record").alias("_first"), F.col("_size").alias("_full"), F.col("_sha1").alias("_full_sha1"))
    again = rows.filter("_type = 'revisit'").select("_record", "_type", "_key", "_uri", "_said", "_first", "_first_key").join(known, "_first", "left")
    lost = F.raise_error(F.concat(F.lit("no response with the digest of revisit "), F.col("_record")))
    again = again.withColumn("_full_sha1", F.when(F.col("_full_sha1").eqNullSafe(F.col("_said")), F.col("_full_sha1")).otherwise(lost))
    out = responses.select("_record", "_key", "_uri", "_type", "_size", "_sha1", F.lit(None).cast("string").alias("_first_key"))
    return out.union(again.select("_record", "_key", "_uri", "_type", "_full", "_full_sha1", "_first_key")).toDF("record_id", "key", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to")


def payload_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, number, data) of each response under path, in chunks."""
    f = F.col("_fields")
    record = F.regexp_extract(F.coalesce(f["WARC-Segment-Origin-ID"], f["WARC-Record-ID"]), "<urn:uuid:(.*)>", 1)
    return segments(spark, path).filter(f["WARC-Type"] != "revisit").select(record.alias("record_id"), (F.coalesce(f["WARC-Segment-Number"].cast("int"), F.lit(1)) - 1).alias("number"), F.col("_payload").alias("data"))
