"""Distances and similarities between array columns, inside whole-stage expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f) -> Column:
    """NULL where the sizes differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_pairs(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(_sum(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), p))), 1.0 / p)


def dot(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def jaccard_sets(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def jaccard_weights(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima."""
    return F.coalesce(_sum(_pairs(a, b, F.least)) / F.nullif(_sum(_pairs(a, b, F.greatest)), F.lit(0.0)), F.lit(0.0))


def mahalanobis(x: Column, mean: list[float], inverse_covariance: list[list[float]]) -> Column:
    """Against a given mean and inverse covariance (driver-side, of fixed dimension)."""
    d = len(mean)
    off = F.zip_with(F.slice(x, 1, d), F.array(*[F.lit(float(m)) for m in mean]), lambda a, m: a.cast("double") - m)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in inverse_covariance])
    # one array function over the rows, not d * d terms: generated code stays small for any dimension
    solved = F.transform(rows, lambda row: _sum(F.zip_with(row, off, lambda v, o: v * o)))
    return F.sqrt(F.greatest(_sum(F.zip_with(solved, off, lambda a, b: a * b)), F.lit(0.0)))
