"""Column functions over ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_array(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(double_array(a), double_array(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(double_array(a), double_array(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    """v over its length, the length at least ``floor``; a null vector stays null."""
    # An array of one holds the length, so it is worked out once, and not again for each coordinate.
    return F.transform(F.array(F.greatest(norm(v), F.lit(floor))), lambda n: F.transform(double_array(v), lambda x: x / n))[0]


def mean_vector(v: Column, dim: int) -> Column:
    """Aggregate: the mean of vectors of one length."""
    return F.array(*[F.avg(double_array(v)[i]) for i in range(dim)])
