"""Greedy near-duplicate collapse of vectors, and compaction of what is left.

In position order a row goes if its dot product with some row that stayed is above the threshold. Edges (pairs above it)
come from exact products of bounded blocks. Every vector belongs to the nearest of a bounded number of pivots (one for each block of vectors, 512 at most); vectors
above the threshold are within sqrt(2 r**2 - 2 threshold) of each other, r being the greatest norm, so two pivots whose
distance less their radii is more than that have no pair, and are left out. What is left is cut into cells of two blocks
each, dealt out over tasks; a cell is one matrix product and emits its edges only. How many cells are left depends on
the data: among vectors without clusters, or at a low threshold, it is all of them, n * n / 2 products. Vectors of up to
`held_bytes` in all need none of this: every task holds them and multiplies its rows by all.

The greedy result is the lexicographically first maximal independent set of the edge graph, found in rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..schemas import NEAR_DUP_COSINE
from ..session import keep, spread
from .blocks import BLOCK, BLOCK_BYTES, BLOCKS, as_given, block_rows, by_cell, matrix
from .positions import with_positions

#: Vectors that stand for a group.
PIVOTS = 512
#: Vectors that every task may hold.
HELD_BYTES = 32 << 20


def _pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y whose dot product is above the threshold; close ones are added up in component order."""
    value = x @ y.T
    p, q = np.nonzero(value > threshold - 1e-9)
    ok = np.ones(len(p), bool)
    for k in np.flatnonzero(value[p, q] < threshold + 1e-9).tolist():
        ok[k] = np.cumsum(x[p[k]] * y[q[k]])[-1] > threshold
    return p[ok], q[ok]


def _held_edges(v: DataFrame, threshold: float) -> DataFrame:
    """near_edges of few vectors (pos, vec)."""
    t = v.toArrow().combine_chunks()  # at most held_bytes of vectors
    size = pc.list_value_length(t["vec"]).to_numpy()
    groups = {int(d): t.filter(pa.array(size == d)).combine_chunks() for d in np.unique(size)}
    held = v.sparkSession.sparkContext.broadcast({d: (g["pos"].combine_chunks().to_numpy(), matrix(g["vec"].combine_chunks())) for d, g in groups.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d, (where, known) in held.value.items():
                same = batch.filter(pa.array(size == d))
                for lo in range(0, same.num_rows, 1024):
                    part = same.slice(lo, 1024)
                    p, q = _pairs(matrix(part.column(1)), known, threshold)
                    a, b = part.column(0).to_numpy()[p], where[q]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], ["a", "b"])

    return spread(v).mapInArrow(run, "a bigint, b bigint")


def near_edges(vecs: DataFrame, threshold: float = NEAR_DUP_COSINE, pos: str = "pos", vec: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(a, b), a < b: positions whose dot product is above the threshold (strictly). Null vectors, and pairs of different lengths, have none."""
    spark = vecs.sparkSession
    v = vecs.select(F.col(pos).cast("bigint").alias("pos"), as_given(vecs, vec).alias("vec")).filter("pos is not null and vec is not null and size(vec) > 0")
    exact, kind = F.col("vec").cast("array<double>"), dict(v.dtypes)["vec"]
    top = v.agg(F.max(dot(exact, exact)).alias("n"), F.max(F.size("vec")).alias("d"), F.count("*").alias("rows")).first()
    reach = 2 * float(top["n"] or 0.0) - 2 * threshold
    if top["d"] is None or reach <= 0:
        return v.select(F.col("pos").alias("a"), F.col("pos").alias("b")).limit(0)
    if 8 * top["d"] * top["rows"] <= held_bytes:
        return _held_edges(v, threshold)
    near, dims = math.sqrt(reach) * (1 + 1e-9) + 1e-9, top["d"]
    held = v.filter(F.size("vec") == dims).orderBy(F.xxhash64("pos"), "pos").limit(min(pivots, top["rows"] // block + 1)).collect()  # at most `pivots` vectors
    centre = spark.sparkContext.broadcast(np.array([r["vec"] for r in held]))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centre.value
        square = (c * c).sum(1)
        for batch in batches:
            size = np.array([len(x) for x in batch.column(1)])
            group, far = -size.astype(np.int64), np.full(len(size), np.inf)
            same = np.flatnonzero(size == dims)
            for lo in range(0, len(same), 4096):
                rows = same[lo : lo + 4096]
                x = matrix(batch.column(1).take(pa.array(rows)))
                away = (x * x).sum(1)[:, None] + square - 2 * (x @ c.T)
                group[rows] = away.argmin(1)
                far[rows] = np.sqrt(np.maximum(away.min(1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(far)], ["pos", "vec", "g", "far"])

    rows = keep(v.mapInArrow(nearest, f"pos bigint, vec {kind}, g bigint, far double"), "vectors")
    # Groups: one for each pivot, and one for each other length of vectors.
    group = rows.groupBy("g").agg(F.max("far").alias("r"), F.ceil(F.count("*") / block).cast("bigint").alias("nb"), F.count("*").alias("n"))
    one, two = group.toDF("g", "r", "nb", "n"), group.toDF("h", "s", "nc", "m")
    at = centre.value
    apart = np.sqrt(np.maximum(((at[:, None, :] - at[None, :, :]) ** 2).sum(2), 0))
    far = spark.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(at)) for j in range(i, len(at))], "g bigint, h bigint, away double")  # at most pivots**2 / 2 rows
    cells = far.join(one, "g").join(two, "h").filter(F.col("away") - F.col("r") - F.col("s") <= near * (1 + 1e-6) + 1e-6)
    own = F.greatest(F.lit(block), F.least(F.ceil(F.col("n") / BLOCKS), F.floor(BLOCK_BYTES / (-8 * F.col("g")))))  # block_rows
    other = group.filter("g < 0").select("g", F.col("g").alias("h"), F.ceil(F.col("n") / own).cast("bigint").alias("nb")).select("g", "h", "nb", F.col("nb").alias("nc"))
    copies = cells.agg(F.sum(F.col("n") * F.col("nc") + F.when(F.col("g") == F.col("h"), 0).otherwise(F.col("m") * F.col("nb")))).first()[0] or 0
    full = -(-top["rows"] // block_rows(top["rows"], dims, block))
    if copies > top["rows"] * (full + 1):
        # Too few groups are apart: fewer, larger blocks without groups move less, and a vector's copies don't grow with the table.
        rows = rows.withColumn("g", F.least("g", F.lit(0).cast("bigint")))
        cells = spark.createDataFrame([(0, 0, full, full)], "g bigint, h bigint, nb bigint, nc bigint")
    cells = keep(cells.select("g", "h", "nb", "nc").unionByName(other), "cells")
    spread = lambda own, n, upto: rows.join(cells, rows["g"] == cells[own]).select("pos", "vec", cells["g"].alias("g"), cells["h"].alias("h"), F.pmod(F.xxhash64("pos"), n).alias("_own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(upto) - 1)).alias("_other"))
    left = spread("g", F.col("nb"), "nc").select("g", "h", F.col("_own").alias("i"), F.col("_other").alias("j"), F.lit(0).alias("side"), "pos", "vec")
    right = spread("h", F.col("nc"), "nb").select("g", "h", F.col("_other").alias("i"), F.col("_own").alias("j"), F.lit(1).alias("side"), "pos", "vec")
    # Within a group a pair of blocks is taken once.
    dealt = left.unionByName(right).filter("g <> h or i <= j").repartition("g", "h", "i", "j").sortWithinPartitions("g", "h", "i", "j")

    def product(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        side, where, x = t.column(4).to_numpy(), t.column(5).to_numpy(), matrix(t.column(6).combine_chunks())
        rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = x[cols]
        step = max(1, min(1024, (1 << 21) // max(len(cols), 1)))  # products held at once
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            p, q = _pairs(x[some], right, threshold)
            a, b = where[some[p]], where[cols[q]]
            if t.column(0)[0] == t.column(1)[0] and t.column(2)[0] == t.column(3)[0]:
                a, b = a[a < b], b[a < b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return dealt.mapInArrow(lambda batches: by_cell(batches, 4, product), "a bigint, b bigint").filter("a < b")


def greedy_keep(rows: DataFrame, edges: DataFrame, pos: str = "pos") -> DataFrame:
    """(pos, keep): whether each row stays. Each round settles every row whose lower neighbours are settled."""
    edges = keep(edges, "edges")
    state = keep(rows.select(F.col(pos).alias("pos")).join(edges.select(F.col("b").alias("pos")).distinct().withColumn("_open", F.lit(True)), "pos", "left").select("pos", F.when(F.col("_open").isNull(), F.lit(True)).alias("keep")), "state")
    while state.filter("keep is null").limit(1).count():
        lower = edges.join(state.select(F.col("pos").alias("a"), F.col("keep").alias("_k")), "a").groupBy("b").agg(F.max(F.when(F.col("_k"), 1).otherwise(0)).alias("_kept"), F.max(F.col("_k").isNull().cast("int")).alias("_open"))
        found = F.when(F.col("_kept") == 1, F.lit(False)).when(F.col("_open") == 0, F.lit(True))
        state = keep(state.join(lower, state["pos"] == lower["b"], "left").select("pos", F.coalesce("keep", found).alias("keep")), "state")
    return state


def drop_near_duplicates(rows: DataFrame, threshold: float = NEAR_DUP_COSINE, pos: str = "pos", vec: str = "embedding") -> DataFrame:
    """The rows that stay."""
    state = greedy_keep(rows, near_edges(rows, threshold, pos, vec), pos)
    return rows.join(state.filter("keep").select(F.col("pos").alias(pos)), pos, "left_semi")


def compact_parents(parents: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents that have a child left, renumbered in order, and children with the new pid."""
    live = parents.join(children.select("pid").distinct(), "pid", "left_semi")
    numbered = keep(with_positions(live, ["pid"], "_new"), "parents")
    new = numbered.select("pid", "_new")
    moved = children.join(new, "pid").drop("pid").withColumnRenamed("_new", "pid")
    return numbered.drop("pid").withColumnRenamed("_new", "pid"), moved
