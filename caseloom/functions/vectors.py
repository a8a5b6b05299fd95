"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a.cast("array<double>"), lambda x: x / norm(a))).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def int8(a: Column) -> Column:
    """Scalar quantisation to whole numbers of -127 to 127."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x)))
    return F.transform(a, lambda x: F.round(x.cast("double") * 127 / top).cast("tinyint"))
