"""How similar unrelated chunks are: the nearest-other cosine of a seeded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CALIBRATION_SAMPLE, CALIBRATION_SEED
from .retrieval import HELD_BYTES, cosine_scores


def calibrate(vecs: DataFrame, n: int, sample: int = CALIBRATION_SAMPLE, seed: int = CALIBRATION_SEED, pos: str = "pos", vec: str = "embedding", held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row (mean, std, sample_size): of at most `sample` rows, drawn without replacement from positions 0..n-1, the greatest dot product with any row at another position (-1 at least); population deviation. Zeros below two rows. A sample of n or more is every row, and nothing is drawn."""
    spark = vecs.sparkSession
    if n < 2:
        return spark.createDataFrame([(0.0, 0.0, 0)], "mean double, std double, sample_size bigint")
    rows = vecs.select(F.col(pos).cast("bigint").alias("pos"), F.col(vec).alias("vec"))
    taken = rows
    if sample < n:
        drawn = np.random.default_rng(seed).choice(n, size=sample, replace=False).tolist()
        taken = rows.join(F.broadcast(spark.createDataFrame([(int(i),) for i in drawn], "pos bigint")), "pos")  # `sample` numbers
    # The two best of a block hold the best at another position.
    scores = cosine_scores(taken.select(F.col("pos").alias("query_id"), F.col("vec").alias("vector")), rows, vec="vec", key="pos", best=2, held_bytes=held_bytes)
    best = scores.filter(F.col("query_id") != F.col("doc")).groupBy(F.col("query_id").alias("pos")).agg(F.max("score").alias("best"))
    found = taken.select("pos").join(best, "pos", "left").select(F.greatest(F.coalesce("best", F.lit(-1.0)), F.lit(-1.0)).alias("best"))
    return found.agg(F.avg("best").alias("mean"), F.stddev_pop("best").alias("std"), F.count("*").alias("sample_size"))
