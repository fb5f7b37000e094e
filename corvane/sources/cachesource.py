"""The page cache as a data source: `spark.read.format("corvane_cache")` and `df.write.format("corvane_cache")`.

Rows (url, etag, last_modified, fetched_at, sha256, body, shelf) lie under `path` in 256 shelves by the first two digits of
the URL's SHA-1, as Parquet files. A read has a partition for each group of shelves and takes filters on url (equal, in)
and on shelf (equal, in): only shelves that can hold such a row are opened, and only such rows leave the reader. A task
writes to a folder of its own; commit moves its files to their shelves, abort drops them. A row of a url that is written
again is added; `latest` in operators/cache terms is up to the reader (greatest fetched_at).

`path` is any URI that Arrow can open (file, hdfs, s3), on a folder that all executors share.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import CACHE

NAME, SHELVES, GROUP = "corvane_cache", [f"{i:02x}" for i in range(256)], 16
_SCHEMA = f"{CACHE}, shelf string"
_ARROW = pa.schema([("url", pa.string()), ("etag", pa.string()), ("last_modified", pa.string()), ("fetched_at", pa.float64()), ("sha256", pa.string()), ("body", pa.string())])


def shelf_of(url: str) -> str:
    return hashlib.sha1(url.encode()).hexdigest()[:2]


def _opened(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


@dataclass
class _Shelves(InputPartition):
    names: list[str]


class CacheReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.urls, self.shelves = path, None, set(SHELVES)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, values = (f.attribute, [f.value] if isinstance(f, EqualTo) else list(f.value)) if isinstance(f, (EqualTo, In)) else (None, [])
            if column == ("url",):
                wanted = {v for v in values if v is not None}
                self.urls = wanted if self.urls is None else self.urls & wanted
                self.shelves &= {shelf_of(u) for u in wanted}
            elif column == ("shelf",):
                self.shelves &= {v for v in values if v is not None}
            else:
                yield f

    def partitions(self) -> list[_Shelves]:
        names = sorted(self.shelves)
        return [_Shelves(names[i : i + GROUP]) for i in range(0, len(names), GROUP)] or [_Shelves([])]

    def read(self, partition: _Shelves) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector

        fs, base = _opened(self.path)
        for shelf in partition.names:
            for info in fs.get_file_info(FileSelector(f"{base}/{shelf}", allow_not_found=True)):
                with fs.open_input_file(info.path) as file:
                    for batch in pq.ParquetFile(file).iter_batches(batch_size=1024):
                        batch = batch if self.urls is None else batch.filter(pc.is_in(batch.column(0), pa.array(sorted(self.urls), pa.string())))
                        if batch.num_rows:
                            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shelf] * batch.num_rows)], [*_ARROW.names, "shelf"])


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: list[tuple[str, str]]


class CacheWriter(DataSourceArrowWriter):
    """Rows of a task are held by shelf up to 16 MB, then written."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, base = _opened(self.path)
        folder, files, held, size = f"{base}/_tasks/{uuid.uuid4().hex}", [], [], 0

        def flush() -> None:
            rows = pa.Table.from_batches(held).select(_ARROW.names).cast(_ARROW)
            rows = rows.filter(pc.is_valid(rows["url"]))
            shelf = pa.array([shelf_of(u) for u in rows["url"].to_pylist()], pa.string())
            for name in pc.unique(shelf).to_pylist():
                target = f"{folder}/{name}-{len(files)}.parquet"
                with fs.open_output_stream(target) as out:
                    pq.write_table(rows.filter(pc.equal(shelf, name)), out)
                files.append((target, f"{base}/{name}/{uuid.uuid4().hex}.parquet"))

        fs.create_dir(folder)
        for batch in iterator:
            held.append(batch)
            size += batch.nbytes
            if size >= 16 << 20:
                flush()
                held, size = [], 0
        if held:
            flush()
        return _Written(folder, files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, base = _opened(self.path)
        if self.overwrite:
            for name in SHELVES:
                if fs.get_file_info(f"{base}/{name}").type.name == "Directory":
                    fs.delete_dir(f"{base}/{name}")
        for m in filter(None, messages):
            for source, target in m.files:
                fs.create_dir(target.rsplit("/", 1)[0])
                fs.move(source, target)
            fs.delete_dir(m.folder)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = _opened(self.path)
        for m in filter(None, messages):
            fs.delete_dir(m.folder)


class CacheSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("the page cache needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> CacheReader:
        return CacheReader(self._path())

    def writer(self, schema: StructType, overwrite: bool) -> CacheWriter:
        return CacheWriter(self._path(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CacheSource)
