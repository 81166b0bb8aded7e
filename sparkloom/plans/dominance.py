"""Sums over the points below and left of each point, without meeting every pair.

Points are cut into blocks of about `size` by the order of x, and again by the order of y. Two points lie in different
blocks on both axes, where the sums of block cells tell all, or share a block on one of them, where a sort of that
block does. A value that fills a block by itself is a block of its own: points that share it never dominate each other
on that axis, so such blocks aren't gathered anywhere. The cells are at most (2 * MOST_BLOCKS + 1) squared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.ordering import running
from sparkloom.plans.staging import stage

LEAST, MOST_BLOCKS = 16384, 512


def below_left(x: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
    """For every point the sums of f (points by columns) over the points smaller in x and in y: a merge by halves."""
    n = len(x)
    out = np.zeros_like(f, dtype=float)
    if n < 2:
        return out
    order = np.lexsort((-y, x))  # among equal x a larger y comes first: it's never smaller in y than what follows
    rank = np.unique(y, return_inverse=True)[1].ravel()[order].astype(np.int64)
    g, sums, at, width = f[order].astype(float), np.zeros_like(f, dtype=float), np.arange(n), 1
    many = int(rank.max()) + 1
    while width < n:
        left = (at // width) % 2 == 0
        by = np.argsort((at // (2 * width) * many + rank) * 2 + left, kind="stable")  # by block and y, of equal ones the right half first
        upto = np.cumsum(np.where(left[by, None], g[by], 0.0), axis=0)
        start = by // (2 * width) * (2 * width)
        before = np.where(start[:, None] > 0, upto[np.maximum(start - 1, 0)], 0.0)
        right = ~left[by]
        sums[by[right]] += (upto - before)[right]
        width *= 2
    out[order] = sums
    return out


def _blocked(points: DataFrame, column: str, key: str, size: int) -> DataFrame:
    """points with their block by the order of a column: even numbers, odd ones for a value with a block of its own."""
    values = points.groupBy(column).agg(F.count("*").alias("__k"))
    placed = running(values, [column], F.col("__k"), "__b", "__t").select(F.col(column).alias("__v"), (2 * F.floor(F.col("__b") / size) + (F.col("__k") > size).cast("long")).alias(key))
    return points.join(placed, F.col(column) == F.col("__v")).drop("__v")


def lower_left_sums(points: DataFrame, weights: dict[str, str], keep: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """x, y, the kept columns, and for each name the sum of its expression over all points with smaller x and smaller y.

    points: distinct (x, y), neither NULL nor NaN.
    """
    spark = points.sparkSession
    names = list(weights)
    points = stage(points.select("x", "y", *keep, *[F.expr(e).cast("double").alias(f"__w_{n}") for n, e in weights.items()]), "points")
    total = points.count()
    size = size or max(LEAST, -(-total // MOST_BLOCKS))
    d = _blocked(_blocked(points, "x", "__i", size), "y", "__j", size)
    d = stage(d.withColumns({f"__s_{n}": F.lit(0.0) for n in names}), "blocked")
    cells = d.groupBy("__i", "__j").agg(*[F.sum(f"__w_{n}").alias(n) for n in names]).toArrow().to_pandas()

    def sums(axis: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # in a block of x any smaller x counts; in a block of y only smaller blocks of x, the others are counted already
            x = pdf["x" if axis == "__i" else "__i"].to_numpy(float)
            got = below_left(x, pdf["y"].to_numpy(float), pdf[[f"__w_{n}" for n in names]].to_numpy(float))
            for k, n in enumerate(names):
                pdf[f"__s_{n}"] += got[:, k]
            return pdf

        return run

    for axis in ("__i", "__j"):
        many = d.where(F.col(axis) % 2 == 0).groupBy(axis).applyInPandas(sums(axis), d.schema)
        d = many.unionByName(d.where(F.col(axis) % 2 == 1))
    rows, columns = np.unique(cells["__i"]), np.unique(cells["__j"])
    at = (np.searchsorted(rows, cells["__i"]), np.searchsorted(columns, cells["__j"]))
    table = {"__ci": cells["__i"].to_numpy(), "__cj": cells["__j"].to_numpy()}
    for n in names:
        grid = np.zeros((len(rows) + 1, len(columns) + 1))
        grid[at[0] + 1, at[1] + 1] = cells[n]
        table[f"__c_{n}"] = grid.cumsum(0).cumsum(1)[at]
    corner = spark.createDataFrame(pa.table(table)) if total else spark.createDataFrame([], ", ".join(["__ci long", "__cj long", *(f"__c_{n} double" for n in names)]))
    d = d.join(corner, (F.col("__i") == F.col("__ci")) & (F.col("__j") == F.col("__cj")))
    return d.select("x", "y", *keep, *[(F.col(f"__s_{n}") + F.col(f"__c_{n}")).alias(n) for n in names])
