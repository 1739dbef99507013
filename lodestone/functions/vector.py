"""Column functions over arrays of numbers. Elements are widened to double first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def l2_normalize(a: Column) -> Column:
    """The unit vector; elements are null for a zero vector."""
    return F.transform(a, lambda x: x.cast("double") / F.nullif(norm(a), F.lit(0.0)))


def lerp(a: Column, b: Column, weight: float) -> Column:
    """weight * a + (1 - weight) * b."""
    return F.zip_with(a, b, lambda x, y: weight * x.cast("double") + (1 - weight) * y.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
