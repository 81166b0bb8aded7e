"""Anomaly detectors over numeric columns: a score in [0, 1] and a flag per row."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.profile import local_outlier_factor, numeric_columns
from sparkloom.plans.ordering import matched, quantiles
from sparkloom.plans.staging import stage

# --- fixed values: rows a tree, its depth, trees ---
SAMPLE, DEPTH, TREES = 256, 8, 100
#: Copies of one vector that are numbered at once when the sample is drawn.
COPIES = 10_000


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that vary and aren't named like identifiers or times."""
    names = [c for c in numeric_columns(df) if not any(w in c.lower().split("_") or c.lower().endswith(w) for w in ("id", "key", "date", "time", "name"))]
    sd = df.agg(*[F.stddev_pop(c).alias(c) for c in names]).first() if names else {}
    return [c for c in names if (sd[c] or 0) >= 0.001]


def _average_path(n: float) -> float:
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0 if n == 2 else 0.0


def isolation_trees(x: np.ndarray, trees: int = TREES, seed: int = 1) -> list[list[tuple]]:
    """Trees as node lists (column, cut, left, right) or (-1, path, 0, 0); the best balanced of three random cuts."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        nodes: list[tuple] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(())
            lo, hi = rows.min(0), rows.max(0)
            live = np.flatnonzero(hi > lo)
            if depth >= DEPTH or len(rows) <= 1 or not len(live):
                nodes[at] = (-1, depth + _average_path(len(rows)), 0, 0)
                return at
            tries = [(int(c), float(rng.uniform(lo[c], hi[c]))) for c in rng.choice(live, 3)]
            c, cut = min(tries, key=lambda t: abs((rows[:, t[0]] < t[1]).mean() - 0.5))
            left = rows[:, c] < cut
            if left.all() or not left.any():
                nodes[at] = (-1, depth + _average_path(len(rows)), 0, 0)
                return at
            a = grow(rows[left], depth + 1)
            b = grow(rows[~left], depth + 1)
            nodes[at] = (c, cut, a, b)
            return at

        grow(x[rng.permutation(len(x))[:SAMPLE]], 0)
        out.append(nodes)
    return out


def isolation_forest(df: DataFrame, columns: Sequence[str], trees: int = TREES, seed: int = 1, sample: int = SAMPLE * 20) -> Column:
    """The score column 2^(-E[path] / c(n)): trees grow on a bounded sample of rows, every row is scored.

    The sample is the rows with the smallest hashes of values and copy: distinct vectors are counted, and the k-th of a
    vector's copies hashes the vector with k, so a vector is drawn as often as its share of the rows says, whatever the
    order and partitions of the table. Copies are numbered in blocks of COPIES, which
    are dealt out, so a vector of very many copies isn't one task.
    """
    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    counted = d.groupBy(*columns).agg(F.count("*").alias("__n"))
    blocks = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES))).alias("__b"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = blocks.repartition(parts, *columns, "__b").select(*columns, F.explode(F.sequence(F.col("__b") * COPIES, F.least((F.col("__b") + 1) * COPIES, F.col("__n")) - 1)).alias("__k"))
    x = np.array([list(r)[:-1] for r in copies.orderBy(F.xxhash64(*columns, "__k", F.lit(seed)), *columns, "__k").limit(sample).collect()], float)
    if not len(x):
        return F.lit(0.0)
    forest = [tuple(np.array(c) for c in zip(*nodes)) for nodes in isolation_trees(x, trees, seed)]
    norm = _average_path(min(SAMPLE, len(x))) or 1.0

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        v = np.stack([c.to_numpy(float) for c in cols], 1)
        total = np.zeros(len(v))
        for col, cut, left, right in forest:
            at = np.zeros(len(v), int)
            for _ in range(DEPTH + 1):
                c = col[at]
                inner = c >= 0
                go = np.where(v[np.arange(len(v)), np.maximum(c, 0)] < cut[at], left[at], right[at])
                at = np.where(inner, go, at)
            total += cut[at]
        return pd.Series(np.power(2.0, -total / len(forest) / norm))

    return score(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def reconstruction_error(df: DataFrame, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """df with the distance to its projection on the first principal components of standardised columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    k = k or max(1, len(columns) // 2)
    d = df.na.drop(subset=list(columns))
    m = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__z", withMean=True), PCA(k=k, inputCol="__z", outputCol="__p")]).fit(d)
    z, p = vector_to_array("__z"), vector_to_array("__p")
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    return m.transform(d).withColumn("error", F.sqrt(F.greatest(square(z) - square(p), F.lit(0.0)))).drop("__v", "__z", "__p")


def series_anomalies(df: DataFrame, time: str, y: str, keys: Sequence[str] = (), window: int = 20, z: float = 3.0, period: int = 0) -> DataFrame:
    """Adds point (z against all), sliding (z against the rows before) and, with a period, seasonal flags."""
    w = Window.partitionBy(*keys).orderBy(time)
    before = w.rowsBetween(-window, -1)
    whole = Window.partitionBy(*keys)
    zs = lambda v, m, s: F.coalesce(F.abs(v - m) / F.nullif(s, F.lit(0.0)), F.lit(0.0)) > z
    v = F.col(y)
    out = df.select("*", zs(v, F.avg(v).over(whole), F.stddev_samp(v).over(whole)).alias("point"), zs(v, F.avg(v).over(before), F.stddev_samp(v).over(before)).alias("sliding"))
    if period > 1:
        out = out.withColumn("__p", F.row_number().over(w) % period)
        s = Window.partitionBy(*keys, "__p")
        out = out.withColumn("seasonal", zs(v, F.avg(v).over(s), F.stddev_samp(v).over(s))).drop("__p")
    return out


def collective(df: DataFrame, time: str, y: str, keys: Sequence[str] = (), width: int = 3, z: float = 3.0) -> DataFrame:
    """Adds collective: the row lies in a stretch of `width` rows whose mean is more than z deviations of all other rows
    from their mean."""
    if width < 3:
        raise ValueError("a stretch has three rows or more")
    v, w = F.col(y).cast("double"), Window.partitionBy(*keys).orderBy(time)
    whole = df.groupBy(*keys).agg(F.count(v).cast("double").alias("__n"), F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s"))
    d = matched(df, whole, keys)
    # about the mean of all: sums of the others follow from those of the stretch
    off = v - F.col("__m")
    span = w.rowsBetween(-(width - 1), 0)
    k, a, b = F.count(v).over(span), F.sum(off).over(span), F.sum(off * off).over(span)
    d = d.select("*", k.alias("__k"), a.alias("__a"), b.alias("__b"))
    rest = F.nullif(F.col("__n") - F.col("__k"), F.lit(0.0))
    mean, square = -F.col("__a") / rest, (F.col("__n") * F.col("__s") * F.col("__s") - F.col("__b")) / rest
    sd = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    far = (F.col("__k") == width) & (F.abs(F.col("__a") / width - mean) / (sd + 1e-10) > z)
    d = d.withColumn("__far", F.coalesce(far, F.lit(False)).cast("int"))
    return d.withColumn("collective", F.max("__far").over(w.rowsBetween(0, width - 1)) == 1).drop("__n", "__m", "__s", "__k", "__a", "__b", "__far")


def detect(df: DataFrame, columns: Sequence[str] | None = None, algorithm: str = "isolation_forest", contamination: float = 0.05, key: str | None = None, seed: int = 1) -> DataFrame:
    """df with score (0 to 1) and anomaly: the scores above the 1 - contamination quantile."""
    columns = list(columns or feature_columns(df))
    if not columns:
        raise ValueError("no column varies")
    if algorithm == "isolation_forest":
        s = df.withColumn("score", isolation_forest(df, columns, seed=seed))
    elif algorithm == "lof":
        if key is None:
            raise ValueError("lof needs a key")
        k = max(1, round(20 * (1 - contamination)))
        lof = local_outlier_factor(df.na.drop(subset=columns), key, columns, k)
        s = df.join(lof, key, "left").withColumn("score", 1 - 1 / F.greatest(F.coalesce("lof", F.lit(1.0)), F.lit(1.0))).drop("lof")
    elif algorithm == "autoencoder":
        e = reconstruction_error(df, columns)
        top = e.agg(F.max("error").alias("__m"))
        s = e.join(top).withColumn("score", F.coalesce(F.col("error") / F.nullif(F.col("__m"), F.lit(0.0)), F.lit(0.0))).drop("error", "__m")
    elif algorithm == "zscore":
        st = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
        far = F.greatest(F.lit(0.0), *[F.coalesce(F.abs(F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns])
        s = df.join(st).withColumn("score", far / (far + 3)).drop(*[f"__{a}_{c}" for a in "ms" for c in columns])
    else:
        raise ValueError(f"unknown detector {algorithm}")
    s = stage(s, "scores")
    cut = quantiles(s, "score", {"__cut": 1 - contamination})
    return s.join(cut).withColumn("anomaly", F.col("score") > F.col("__cut")).drop("__cut")


def ensemble(df: DataFrame, key: str, columns: Sequence[str], algorithms: Sequence[str] = ("isolation_forest", "autoencoder", "zscore"), how: str = "average", contamination: float = 0.05) -> DataFrame:
    """key, score, anomaly by averaging the scores, or by voting (more than half of the flags)."""
    out = None
    for a in algorithms:
        one = detect(df, columns, a, contamination, key).select(key, F.col("score").alias(f"s_{a}"), F.col("anomaly").alias(f"a_{a}"))
        out = one if out is None else out.join(one, key)
    score = sum((F.col(f"s_{a}") for a in algorithms), F.lit(0.0)) / len(algorithms)
    votes = sum((F.col(f"a_{a}").cast("int") for a in algorithms), F.lit(0))
    if how == "vote":
        return out.select(key, score.alias("score"), (votes * 2 > len(algorithms)).alias("anomaly"))
    s = stage(out.select(key, score.alias("score")), "scores")
    return s.join(quantiles(s, "score", {"__c": 1 - contamination})).select(key, "score", (F.col("score") > F.col("__c")).alias("anomaly"))
