"""Scalar functions over array<double> columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column, eps: float = 0.0) -> Column:
    """The vector over its length plus ``eps``; a zero vector stays zero where ``eps`` is 0."""
    length = norm(a) + F.lit(eps)
    return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / F.nullif(length, F.lit(0.0))))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine within [0, 2]; a zero vector counts as one of length 1."""
    na, nb = norm(a), norm(b)
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / (one(na) * one(nb))))


def rbf(squared: Column, sigma: Column | float) -> Column:
    """Gaussian kernel of a squared distance."""
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    return F.exp(-squared / (2 * s * s))


def argmax_first(value: Column, index: Column) -> Column:
    """Aggregate: the index of the greatest value, the smallest on a tie."""
    return F.max_by(index, F.struct(value, -index))


def argmin_first(value: Column, index: Column) -> Column:
    return F.min_by(index, F.struct(value, index))
