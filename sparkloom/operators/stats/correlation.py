"""Dependence between two columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.stats.special import student_cdf
from sparkloom.plans.dominance import lower_left_sums
from sparkloom.plans.ordering import average_ranks, running
from sparkloom.plans.staging import stage


def _complete(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def _with_test(spark, r: float, n: int, name: str) -> DataFrame:
    """Two-sided t test and Fisher interval at 95 %."""
    if n < 3 or abs(r) >= 1:
        p, lo, hi = (0.0 if n >= 3 else 1.0), r, r
    else:
        p = 2 * (1 - student_cdf(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2))
        half = 1.96 / math.sqrt(n - 3) if n > 3 else math.inf
        lo, hi = math.tanh(math.atanh(r) - half), math.tanh(math.atanh(r) + half)
    return spark.createDataFrame([(name, float(r), float(p), float(lo), float(hi), n)], "measure string, value double, p_value double, low double, high double, n long")


def _pearson(pairs: DataFrame) -> tuple[float, int]:
    r = pairs.agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("a"), F.stddev_pop("y").alias("b"), F.count("*").alias("n")).first()
    return (r.c / (r.a * r.b) if r.a and r.b else 0.0), r.n


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    r, n = _pearson(_complete(df, x, y))
    return _with_test(df.sparkSession, r, n, "pearson")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson on average ranks."""
    ranked = average_ranks(average_ranks(_complete(df, x, y), "x", "rx"), "y", "ry")
    r, n = _pearson(ranked.select(F.col("rx").alias("x"), F.col("ry").alias("y")))
    return _with_test(df.sparkSession, r, n, "spearman")


def _weighted(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs with their counts: fewer points, with the same result. NaN pairs are left out."""
    return _complete(df, x, y).where(~F.isnan("x") & ~F.isnan("y")).groupBy("x", "y").agg(F.count("*").alias("n"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """(C - D) / (C + D) over all pairs: C from the points below and left of each, D from the ties."""
    pts = stage(_weighted(df, x, y), "weighted")
    low = lower_left_sums(pts, {"s": "n"}, ("n",)).agg(F.coalesce(F.sum((F.col("n") * F.col("s")).cast("decimal(38,0)")), F.lit(0)).alias("c"))
    pairs = lambda d, name: d.agg(F.coalesce(F.sum((F.col("m").cast("decimal(19,0)") * (F.col("m") - 1) / 2).cast("decimal(38,0)")), F.lit(0)).alias(name))
    tied = lambda *by: pts.groupBy(*by).agg(F.sum("n").alias("m"))
    t = pairs(tied(), "t").join(pairs(tied("x"), "tx")).join(pairs(tied("y"), "ty")).join(pairs(tied("x", "y"), "txy")).join(low)
    t = t.select(F.col("c").cast("double").alias("concordant"), F.expr("CAST(t - tx - ty + txy - c AS DOUBLE)").alias("discordant"))
    c, d = F.col("concordant"), F.col("discordant")
    return t.select(F.coalesce((c - d) / F.nullif(c + d, F.lit(0.0)), F.lit(0.0)).alias("kendall"), "concordant", "discordant")


def _distance_sums(points: DataFrame, axis: str, out: str) -> DataFrame:
    """The axis' distinct values v and, as `out`, the sum of distances to all points, from running sums in order."""
    values = points.groupBy(axis).agg(F.sum("n").alias("m"))
    one = running(values, [axis], F.col("m"), "below", "all")
    two = running(one, [axis], F.col("m") * F.col(axis), "moment", "moments")
    v = F.col(axis)
    above, far = F.col("all") - F.col("below") - F.col("m"), F.col("moments") - F.col("moment") - F.col("m") * v
    return two.select(v.alias("v"), (v * F.col("below") - F.col("moment") + far - v * above).alias(out))


def distance_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distance sums of each value come from running sums; products of distances are those of differences, with their
    sign turned for discordant pairs, so the points below and left of each give them. Nothing meets in pairs.
    """
    spark = df.sparkSession
    raw = stage(_weighted(df, x, y), "weighted")
    m = raw.agg(F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"m{c}") for c in "xy"]).first()
    if (m.n or 0) < 2:
        return spark.createDataFrame([(0.0,)], "distance_correlation double")
    sd = raw.agg(*[F.sqrt(F.sum(F.col("n") * F.pow(F.col(c) - m[f"m{c}"], 2)) / m.n).alias(c) for c in "xy"]).first()
    if not (sd.x and sd.y):
        return spark.createDataFrame([(0.0,)], "distance_correlation double")
    # centred and scaled: the measure doesn't change, and sums of products keep their digits
    pts = stage(raw.select(*[((F.col(c) - m[f"m{c}"]) / sd[c]).alias(c) for c in "xy"], "n"), "scaled")
    both = pts.join(_distance_sums(pts, "x", "a").withColumnRenamed("v", "vx"), F.col("x") == F.col("vx")).join(_distance_sums(pts, "y", "b").withColumnRenamed("v", "vy"), F.col("y") == F.col("vy"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    r = both.agg(F.sum(n * a).alias("tx"), F.sum(n * b).alias("ty"), F.sum(n * a * b).alias("rxy"), F.sum(n * a * a).alias("rxx"), F.sum(n * b * b).alias("ryy"), *[F.sum(e).alias(k) for k, e in (("sx", n * F.col("x")), ("sy", n * F.col("y")), ("sxy", n * F.col("x") * F.col("y")), ("sxx", n * F.col("x") * F.col("x")), ("syy", n * F.col("y") * F.col("y")))]).first()
    low = lower_left_sums(pts, {"w": "n", "wx": "n * x", "wy": "n * y", "wxy": "n * x * y"}, ("n",))
    concordant = low.agg(F.sum(F.expr("n * (x * y * w - x * wy - y * wx + wxy)")).alias("p")).first().p or 0.0
    big = float(m.n)
    xy = 2 * (2 * concordant - (big * r.sxy - r.sx * r.sy))
    xx, yy = 2 * (big * r.sxx - r.sx * r.sx), 2 * (big * r.syy - r.sy * r.sy)
    cov = lambda s, rr, t: max(0.0, s / big**2 - 2 * rr / big**3 + t / big**4)
    v, va, vb = cov(xy, r.rxy, r.tx * r.ty), cov(xx, r.rxx, r.tx * r.tx), cov(yy, r.ryy, r.ty * r.ty)
    return spark.createDataFrame([(math.sqrt(v / math.sqrt(va * vb)) if va > 0 and vb > 0 else 0.0,)], "distance_correlation double")


def hoeffding_d(df: DataFrame, x: str, y: str) -> DataFrame:
    """Hoeffding's D, scaled by 30: average ranks, and bivariate ranks from the points below and left of each, ties by half."""
    pts = stage(_weighted(df, x, y), "weighted")
    q = lower_left_sums(pts, {"low": "n"}, ("n",))
    # points with the same y and a smaller x, and the other way round
    row = running(pts, ["x"], F.col("n"), "west", "in_row", ("y",)).select(F.col("x").alias("x1"), F.col("y").alias("y1"), "west", "in_row")
    column = running(pts, ["y"], F.col("n"), "south", "in_column", ("x",)).select(F.col("x").alias("x2"), F.col("y").alias("y2"), "south", "in_column")
    rank = lambda axis, out: running(pts.groupBy(axis).agg(F.sum("n").alias("m")), [axis], F.col("m"), "b", "t").select(F.col(axis).alias(f"v_{out}"), (F.col("b") + (F.col("m") + 1) / 2).alias(out))
    d = q.join(row, (F.col("x") == F.col("x1")) & (F.col("y") == F.col("y1"))).join(column, (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))
    d = d.join(rank("x", "r"), F.col("x") == F.col("v_r")).join(rank("y", "s"), F.col("y") == F.col("v_s"))
    d = d.withColumn("q", F.expr("1 + low + west / 2 + south / 2 + (n - 1) / 4"))
    t = d.agg(F.sum("n").cast("double").alias("n"), F.sum(F.expr("n * (q - 1) * (q - 2)")).alias("d1"), F.sum(F.expr("n * (r - 1) * (r - 2) * (s - 1) * (s - 2)")).alias("d2"), F.sum(F.expr("n * (r - 2) * (s - 2) * (q - 1)")).alias("d3"))
    n = F.col("n")
    value = 30 * ((n - 2) * (n - 3) * F.col("d1") + F.col("d2") - 2 * (n - 2) * F.col("d3")) / F.nullif(n * (n - 1) * (n - 2) * (n - 3) * (n - 4), F.lit(0.0))
    return t.select(F.coalesce(value, F.lit(0.0)).alias("hoeffding_d"))


#: Finest equal-frequency bins of each axis that grids are made from.
FINE = 1024


def maximal_information(df: DataFrame, x: str, y: str, most: int = 0) -> DataFrame:
    """Largest normalised mutual information over all equal-frequency grids of a by b <= n^0.6 cells (or `most`).

    One aggregation counts the points by FINE bins of either rank; every allowed pair of sides is then tried on those
    counts, in as many tasks as there are sides. Up to FINE values the bins are the ranks; beyond, the sides of a grid
    lie on the nearest edge of a bin.
    """
    spark = df.sparkSession
    pts = stage(average_ranks(average_ranks(_complete(df, x, y), "x", "rx"), "y", "ry").select("rx", "ry"), "mic")
    n = pts.count()
    cells = most or max(4, int(n**0.6))
    if n < 4 or cells < 4:
        return spark.createDataFrame([(0.0,)], "mic double")
    # a point's place on an axis is (rank - 1/2) / n: exact in half ranks, or the middle of a bin
    exact = n <= FINE
    bin_of = (lambda r: (2 * F.col(r)).cast("int") - 1) if exact else (lambda r: F.least(F.floor((F.col(r) - 0.5) * FINE / n), F.lit(FINE - 1)).cast("int"))
    counted = pts.groupBy(bin_of("rx").alias("i"), bin_of("ry").alias("j")).agg(F.count("*").alias("c")).toArrow()  # at most FINE * FINE cells
    shared = spark.sparkContext.broadcast(tuple(counted.column(k).to_numpy() for k in "ijc"))

    def search(batches):
        i, j, c = shared.value
        place = (lambda k: k / (2 * n)) if exact else (lambda k: (k + 0.5) / FINE)
        (vi, at_i), (vj, at_j) = (np.unique(k, return_inverse=True) for k in (i, j))
        full = np.zeros((len(vi), len(vj)))
        full[at_i, at_j] = c
        starts = lambda v, k: np.flatnonzero(np.diff(np.minimum((place(v) * k).astype(int), k - 1), prepend=-1))
        entropy = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
        for pdf in batches:
            best = 0.0
            for a in pdf["a"]:
                rows = np.add.reduceat(full, starts(vi, a), axis=0)
                hx = entropy(rows.sum(1) / n)
                for b in range(2, cells // a + 1):
                    grid = np.add.reduceat(rows, starts(vj, b), axis=1) / n
                    best = max(best, (hx + entropy(grid.sum(0)) - entropy(grid)) / math.log(min(a, b)))
            yield pd.DataFrame({"mic": [best]})

    # a side a has cells / a grids: sides are dealt so that small and large ones mix
    sides = spark.createDataFrame(pd.DataFrame({"a": np.arange(2, cells // 2 + 1)})).repartition(min(cells // 2, max(2, spark.sparkContext.defaultParallelism * 4)), "a")
    return sides.mapInPandas(search, "mic double").agg(F.max("mic").alias("mic"))


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs of Pearson correlations in one aggregation: a, b, r (0 without variance)."""
    from sparkloom.functions.aggregates import corr

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")
