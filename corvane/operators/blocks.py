"""Exact products of vectors, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a block at least (two blocks are a cell, one matrix product).
BLOCK = 2048
#: Blocks that a table is cut into, as long as they hold no more than BLOCK_BYTES: each vector goes to as many cells.
BLOCKS, BLOCK_BYTES = 16, 32 << 20


def block_rows(rows: int, dims: int, block: int = BLOCK) -> int:
    """Vectors of a block: so many that the number of blocks, and with it how often a vector is shuffled, doesn't grow with the table until blocks are full."""
    return max(block, min(-(-rows // BLOCKS), BLOCK_BYTES // (8 * max(dims, 1))))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return column.flatten().to_numpy().astype(np.float64, copy=False).reshape(len(column), -1)


def as_given(df: DataFrame, vec: str) -> Column:
    """Vectors as numbers that Python takes: single precision stays, at half the bytes to shuffle; others become doubles."""
    return F.col(vec) if dict(df.dtypes)[vec] == "array<float>" else F.col(vec).cast("array<double>")


def by_cell(batches: Iterator[pa.RecordBatch], keys: int, product: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """product() of each run of rows that agree in the first `keys` columns (integers), one run in memory at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and tuple(key[lo]) != last:
                yield from product(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(key[lo])
    if held:
        yield from product(held)
