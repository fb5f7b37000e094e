"""Connected components of an edge table, by alternating large-star and small-star steps.

Before the first step, each task contracts what edges it holds, a bounded number at a time: a union-find over them leaves
one edge for each of their nodes but the least of a component. Every step is a group minimum and a join on the same key;
edges stay as many as nodes at most once the graph is a star forest, and rounds grow with the logarithm of the longest
path. The loop ends when every edge leads to a node that leads nowhere, and no node has two. Each round is a table in the
shared folder, and so are its minima, so that the join with them can be split where a node has very many edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_deleted
from .shared import release_table, stage

#: Edges that a task contracts at once.
HELD = 1 << 18


def contract(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of the component of each of n nodes, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if not (low < high).any():
            return root
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        both = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).combine_chunks()
        return _stars(both, t.num_rows)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= HELD:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def _stars(both: pa.Array, n: int) -> pa.RecordBatch:
    if pa.types.is_integer(both.type):
        names, at = np.unique(both.to_numpy(), return_inverse=True)
        root = contract(at[:n], at[n:], len(names))
        child = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[root[child]])], ["a", "b"])
    nodes = both.to_pylist()
    key = (lambda v: tuple(v.values())) if pa.types.is_struct(both.type) else (lambda v: v)
    names = sorted({key(v): v for v in nodes}.items())
    number = {k: i for i, (k, _) in enumerate(names)}
    at = np.array([number[key(v)] for v in nodes], np.int64)
    root = contract(at[:n], at[n:], len(names))
    child = np.flatnonzero(root != np.arange(len(names)))
    pick = lambda rows: pa.array([names[i][1] for i in rows.tolist()], both.type)
    return pa.RecordBatch.from_arrays([pick(child), pick(root[child])], ["a", "b"])


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one edge upwards at most, and none if another leads to it."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    with shuffles_deleted(edges.sparkSession):
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b) that isn't its component's least node, root being that."""
    rows = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(rows.mapInArrow(_contracted, rows.schema).distinct(), "edges")
    while not _is_forest(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        out = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, stage(out, "edges")
        for table in (before, least):
            release_table(table)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
