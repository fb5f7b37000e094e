"""Global 0-based positions without a global window: range partitions are numbered by themselves, then offset."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep


def with_positions(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """df with its rank in `order` (a unique order) as bigint column `name`."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = keep(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "positions")
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())  # one row per partition
    before = [0, *itertools.accumulate(n for _, n in counts)]
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part int, _before bigint")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*cols)) - 1
    return parts.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")
