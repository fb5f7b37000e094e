"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import INT8_SCALE


def quantise(v: Column, scale: int = INT8_SCALE) -> Column:
    """Each component times scale in single precision, rounded half to even, clipped to a signed byte."""
    return F.transform(v, lambda x: F.greatest(F.lit(-float(scale)), F.least(F.lit(float(scale)), F.rint(x.cast("float") * F.lit(scale).cast("float")))).cast("tinyint"))


def dequantise(v: Column, scale: int = INT8_SCALE) -> Column:
    return F.transform(v, lambda x: x.cast("double") / scale)


def dot(a: Column, b: Column) -> Column:
    """In double precision, in component order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))
