"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, shared_path, shuffles_deleted

__all__ = ["delete", "new_path", "reads", "recorded", "release", "release_table", "scope", "stage"]

_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; inside a scope it goes with the scope."""
    path = shared_path(spark, name)
    if _open:
        _open[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reads(df: DataFrame) -> set[str]:
    """Root paths of the files that df reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            out |= {paths.apply(j).toString() for j in range(paths.size())}
    return out


def release_table(df: DataFrame) -> None:
    """Delete what stage() wrote for df, which nothing reads any more."""
    for path in reads(df):
        delete(df.sparkSession, path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of intermediate tables made within."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()
        if _open:
            _open[-1].extend(made)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made within, when it is left: write what is wanted before, outside of the shared tables."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once and read it back: later plans read a table that outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_deleted(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this module; results that were not written yet are lost with them."""
    delete(spark, shared_dir(spark))
