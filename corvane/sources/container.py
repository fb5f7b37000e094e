"""Reading the single-file index: 4 bytes of header length (little-endian), a JSON header, raw vectors."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..schemas import CHILD, PARENT


@dataclass
class Container:
    header: dict
    vectors: np.ndarray

    def parents(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *[p[k] for k in ("t", "x", "u", "host", "kind", "weight")]) for i, p in enumerate(self.header["parents"])], f"pid bigint, {PARENT}")

    def children(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *[c[k] for k in ("t", "x", "u", "host", "kind", "weight", "pid")], v.tolist()) for i, (c, v) in enumerate(zip(self.header["chunks"], self.vectors.astype(float), strict=True))], f"doc bigint, {CHILD}, embedding array<double>")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, d, n) for t, x in self.header["bm25"]["postings"].items() for d, n in x], "term string, doc bigint, tf bigint")


def parse(data: bytes) -> Container:
    (size,) = struct.unpack_from("<I", data)
    header = json.loads(data[4 : 4 + size])
    whole = header.get("vecsQ") == "i8"
    v = np.frombuffer(data, np.int8 if whole else np.dtype("<f4"), offset=4 + size).reshape(len(header["chunks"]), header["dims"])
    return Container(header, v.astype(np.float32) / header["vecsScale"] if whole else v)


def read(spark: SparkSession, path: str) -> Container:
    """Read by Spark, from any store."""
    return parse(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
