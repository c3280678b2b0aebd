"""Vector arithmetic on array columns (VEC01-04, VEC07); vectors are cast to double first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column, floor: float = 1e-8) -> Column:
    """Divided by the norm, or by ``floor`` if that is larger. The norm is an array of one, so that it isn't made anew for each component."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(floor)))), 1)


def scrubbed(v: Column) -> Column:
    """Components that are no finite number become 0."""
    return F.transform(v, lambda x: F.when(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def n_bad(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))))
