"""Aggregate functions of the dialect: plain Catalyst aggregates, so they combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_or_zero(x: Column) -> Column:
    """SUM that is 0 for no rows."""
    return F.coalesce(F.sum(x), F.lit(0))


def avg_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def stddev(x: Column) -> Column:
    """Population deviation; NULL below two values."""
    return F.when(F.count(x) >= 2, F.stddev_pop(x))


def variance(x: Column) -> Column:
    return F.when(F.count(x) >= 2, F.var_pop(x))


def percentile_cont(x: Column, p: float = 0.5) -> Column:
    """Linear interpolation at p * (n - 1), exact."""
    return F.percentile(x, p)


def _pairs(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x.cast("double")), F.when(both, y.cast("double"))


def corr(x: Column, y: Column) -> Column:
    """Pearson over complete pairs; 0 where a variance is 0 or below two pairs; within [-1, 1]."""
    a, b = _pairs(x, y)
    r = F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0))))


def regr_slope(x: Column, y: Column) -> Column:
    """Slope of y on x: the first argument is the independent one; 0 where x doesn't vary."""
    a, b = _pairs(x, y)
    return F.coalesce(F.covar_pop(a, b) / F.nullif(F.var_pop(a), F.lit(0.0)), F.lit(0.0))


def count_true(x: Column) -> Column:
    """COUNT over a CASE: values other than 0 and NULL."""
    return F.count_if(x != 0)
