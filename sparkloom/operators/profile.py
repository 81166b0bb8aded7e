"""ANALYZE DATA: profiles, correlation, importance, clustering, outliers, distribution, time series and quality.

Every analysis is a DataFrame; only report texts are put together on the driver.
"""

from __future__ import annotations

import json
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.aggregates import corr
from sparkloom.operators.stats import descriptive as D
from sparkloom.operators.stats.information import binned
from sparkloom.plans import ordering
from sparkloom.plans.ordering import average_ranks
from sparkloom.plans.staging import stage, write_text

TYPES = ("SUMMARY", "COMPREHENSIVE", "CORRELATION", "IMPORTANCE", "CLUSTERING", "OUTLIER", "DISTRIBUTION", "TIMESERIES", "QUALITY")
# --- fixed values of the quality report: patterns, weights of the six scores, scores without a measurement, limits ---
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
URL = r"^(https?|ftp)://[^\s/$.?#].[^\s]*$"
WEIGHTS = {"completeness": 0.2, "consistency": 0.15, "accuracy": 0.15, "timeliness": 0.1, "validity": 0.2, "uniqueness": 0.2}
ACCURACY, TIMELINESS = 0.9, 0.9
EXTREME, LONG_TEXT, OLDEST = 1e6, 1000, 150


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long(df: DataFrame, exprs: dict[str, dict[str, Column]], types: dict[str, str]) -> DataFrame:
    """One aggregation for all columns, turned into a row per column."""
    flat = [e.cast(types[m]).alias(f"{i}_{m}") for i, ms in enumerate(exprs.values()) for m, e in ms.items()]
    one = df.agg(*flat)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{m}").alias(m) for m in ms]) for i, (c, ms) in enumerate(exprs.items())])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def detect_types(df: DataFrame) -> DataFrame:
    """column, type (integer, float, boolean, categorical, datetime, string), distinct, count."""
    exprs = {c: {"distinct": F.countDistinct(c), "n": F.count(c)} for c in df.columns if not isinstance(df.schema[c].dataType, T.ArrayType | T.MapType | T.StructType)}
    kinds = F.create_map(*[x for c in exprs for x in (F.lit(c), F.lit(_kind(df.schema[c].dataType)))])
    out = _long(df, exprs, {"distinct": "long", "n": "long"})
    k = F.element_at(kinds, F.col("column"))
    few = (F.col("distinct") <= 100) & (F.col("distinct") < 0.1 * F.col("n"))
    return out.select("column", F.when((k == "string") & few, "categorical").otherwise(k).alias("type"), "distinct", "n")


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, T.NumericType):
        return "float"
    return "datetime" if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else "string"


_PS = {"p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, v, n: the distinct values of all columns with their counts, in one shuffle, staged."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")
    return stage(df.select(pairs).select("p.column", "p.v").where("v IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias("n")), "counted")


def quantiles(values: DataFrame, ps: dict[str, float]) -> DataFrame:
    """column and one exact quantile per name, from distinct values weighted by their counts."""
    return ordering.quantiles(values, "v", ps, ("column",), "n")


def summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, nulls, distinct, moments, quantiles, Jarque-Bera and IQR outliers of every numeric column.

    Moments come from one pass over the rows; distinct counts, quantiles and outliers from the counted values.
    """
    columns = columns or numeric_columns(df)
    measures: dict[str, dict[str, Column]] = {}
    for name in columns:
        x = F.col(name).cast("double")
        jb = F.count(x) / 6 * (D.skewness(x) * D.skewness(x) + D.kurtosis(x) * D.kurtosis(x) / 4)
        measures[name] = {"n": F.count(x), "nulls": F.count_if(x.isNull()), "mean": F.avg(x), "stddev": D.stddev(x), "min": F.min(x), "max": F.max(x), "skewness": D.skewness(x), "kurtosis": D.kurtosis(x), "cv": D.coefficient_of_variation(x), "jarque_bera": jb}
    base = _long(df, measures, {m: "long" if m in ("n", "nulls") else "double" for m in next(iter(measures.values()))})
    values = counted(df, columns)
    q = quantiles(values, _PS)
    far = F.when((F.col("v") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col("v") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))), F.col("n")).otherwise(0)
    rest = values.join(q, "column").groupBy("column", *_PS).agg(F.count("*").alias("distinct"), F.sum(far).alias("outliers"))
    zero = {"distinct": F.coalesce("distinct", F.lit(0)), "outliers": F.coalesce("outliers", F.lit(0))}
    return base.join(rest, "column", "left").withColumns(zero).select("column", "n", "nulls", "distinct", "mean", "stddev", "min", "p10", "q1", "median", "q3", "p90", "p95", "p99", "max", "skewness", "kurtosis", "cv", "jarque_bera", "outliers")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, low, high, n of equal-width bins; empty bins are left out."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    return binned(df, column, bins, "bin").groupBy("bin").agg(F.count("*").alias("n")).join(ends).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def categories(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The top categories with share; rare under 1 %, dominant over 10 %."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return n.select("category", "n", share.alias("share"), (share < 0.01).alias("rare"), (share > 0.1).alias("dominant")).orderBy(F.desc("n"), "category").limit(top)


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.8, "very strong").when(a >= 0.6, "strong").when(a >= 0.4, "moderate").when(a >= 0.2, "weak").otherwise("very weak")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson and Spearman with strength, class, and the regression line of b on a, for every pair of columns."""
    columns = columns or numeric_columns(df)
    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        d = average_ranks(d, c, f"__r_{c}")
    d = stage(d, "ranks")
    pairs = list(combinations(columns, 2))
    exprs: dict[str, dict[str, Column]] = {}
    for a, b in pairs:
        x, y = F.col(a), F.col(b)
        slope = F.coalesce(F.covar_pop(x, y) / F.nullif(F.var_pop(F.when(y.isNotNull(), x)), F.lit(0.0)), F.lit(0.0))
        exprs[f"{a}\0{b}"] = {"pearson": corr(x, y), "spearman": corr(F.col(f"__r_{a}"), F.col(f"__r_{b}")), "slope": slope, "intercept": F.avg(F.when(x.isNotNull(), y)) - slope * F.avg(F.when(y.isNotNull(), x)), "n": F.count_if(x.isNotNull() & y.isNotNull())}
    out = _long(d, exprs, {"pearson": "double", "spearman": "double", "slope": "double", "intercept": "double", "n": "long"})
    p, s = F.col("pearson"), F.col("spearman")
    kind = F.when(F.abs(p) >= 0.6, "linear").when(F.abs(s) >= 0.6, "monotonic").when((F.abs(p) < 0.2) & (F.abs(s) < 0.2), "none").otherwise("nonlinear")
    parts = F.split("column", "\0")
    return out.select(parts[0].alias("a"), parts[1].alias("b"), "n", "pearson", "spearman", "slope", "intercept", strength(p).alias("strength"), kind.alias("relation"))


#: A feature with so many values at most counts as categorical.
FEW = 10


def scores(df: DataFrame, target: str, features: list[str], bins: int = 20) -> DataFrame:
    """Per feature |pearson|, |spearman|, mutual information, |slope|, and where it has FEW values at most chi-square
    against the target's five parts of equal frequency and one-way F."""
    from sparkloom.operators.stats.tests import anova, chi_square

    d = stage(df.select(target, *features).na.drop(), "importance")
    n = d.count()
    y = F.col(target).cast("double")
    parts = max(2, min(5, n // 10))
    cuts = ordering.at_places(d, target, {f"c{b}": b * n // parts for b in range(1, parts)}).first()
    part = F.lit(0)
    for b in range(1, parts):
        part = F.when(y > F.lit(cuts[f"c{b}"]), b).otherwise(part)
    d = d.withColumn("__part", part)
    ranked = average_ranks(d, target, "__ry")
    j = binned(d, target, bins, "__j")
    out = None
    for f in features:
        x = F.col(f).cast("double")
        line = d.agg(F.abs(corr(x, y)).alias("pearson"), F.abs(F.coalesce(F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0)), F.lit(0.0))).alias("slope"), F.countDistinct(f).alias("values"))
        rank = average_ranks(ranked, f, "__rx").agg(F.abs(corr(F.col("__rx"), F.col("__ry"))).alias("spearman"))
        c = binned(j, f, bins, "__i").groupBy("__i", "__j").agg(F.count("*").alias("c"))
        all_, ci, cj = (F.sum("c").over(w) for w in (Window.partitionBy(), Window.partitionBy("__i"), Window.partitionBy("__j")))
        mi = c.select((F.col("c") / all_).alias("p"), (ci / all_).alias("a"), (cj / all_).alias("b")).agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("a") * F.col("b")))).alias("mutual_information"))
        one = line.join(rank).join(mi)
        if 1 < (line.first()["values"] or 0) <= FEW:
            one = one.join(chi_square(d, f, "__part").select(F.col("statistic").alias("chi_square"))).join(anova(d, target, f).select(F.col("statistic").alias("anova_f")))
        else:
            one = one.withColumn("chi_square", F.lit(None).cast("double")).withColumn("anova_f", F.lit(None).cast("double"))
        one = one.select(F.lit(f).alias("column"), "values", "pearson", "spearman", "mutual_information", "slope", "chi_square", "anova_f")
        out = one if out is None else out.union(one)
    return out


def importance(df: DataFrame, target: str, features: list[str] | None = None, bins: int = 20) -> DataFrame:
    """The scores of each feature and a boosted-tree importance, highest tree importance first."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from sparkloom.operators.ml import spread

    features = features or [c for c in numeric_columns(df) if c != target]
    d = df.select(target, *features).na.drop()
    model = GBTRegressor(labelCol=target, featuresCol="__f", maxIter=10, maxDepth=4, seed=1).fit(VectorAssembler(inputCols=features, outputCol="__f").transform(spread(d, d.count())))
    tree = df.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())], "column string, tree double")
    return scores(df, target, features, bins).join(tree, "column").orderBy(F.desc("tree"), "column")


def clusters(df: DataFrame, columns: list[str], k: int | None = None, most: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """k-means on standardised columns; k by the elbow's largest curvature. Rows with their cluster, and a profile."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    d = df.na.drop(subset=columns)
    prep = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)]).fit(d)
    x = prep.transform(d)
    fits = lambda n: KMeans(k=n, seed=seed, featuresCol="__x", predictionCol="cluster", maxIter=100).fit(x)
    if k is None:
        x = x.persist()
        try:
            cost = [fits(n).summary.trainingCost for n in range(2, most + 1)]
        finally:
            x.unpersist()
        bend = [cost[i - 1] - 2 * cost[i] + cost[i + 1] for i in range(1, len(cost) - 1)]
        k = 3 + int(np.argmax(bend)) if bend else 2
    m = fits(k)
    out = m.transform(x)
    quality = ClusteringEvaluator(featuresCol="__x", predictionCol="cluster").evaluate(out) if k > 1 else 0.0
    profile = out.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns]).withColumn("silhouette", F.lit(float(quality)))
    return out.drop("__raw", "__x"), profile


def _closest(p: pd.DataFrame, q: pd.DataFrame, key: str, columns: list[str], k: int, same: bool) -> pd.DataFrame:
    """key, d, id: the k rows of q nearest to each row of p, by distance, then by id."""
    q = q.sort_values(key, kind="stable")
    square = np.zeros((len(p), len(q)))
    for c in columns:
        square += np.subtract.outer(p[c].to_numpy(float), q[c].to_numpy(float)) ** 2
    if same:
        square[p[key].to_numpy()[:, None] == q[key].to_numpy()[None]] = np.inf
    m = min(k, len(q))
    at = np.argsort(square, axis=1, kind="stable")[:, :m]
    r = np.repeat(np.arange(len(p)), m)
    out = pd.DataFrame({key: p[key].to_numpy()[r], "d": np.sqrt(square[r, at.ravel()]), "id": q[key].to_numpy()[at.ravel()]})
    return out[np.isfinite(out["d"])]


def nearest(df: DataFrame, key: str, columns: list[str], k: int, size: int = 2048) -> DataFrame:
    """key, neighbours array<struct<d, id>>: the k nearest other rows, exactly.

    Rows are cut into blocks along the column that varies most. A row's k nearest in its own block bound how far away
    the others can be, so it visits only blocks whose stretch of that column comes as near; k a row leave each block.
    Rows with a NULL in a column are left out; keys are unique.
    """
    spark = df.sparkSession
    d = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(subset=columns)
    spread = d.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    lead = max(columns, key=lambda c: spread[c] or 0.0)
    d = stage(ordering.running(d, [lead, key]).withColumn("__b", F.floor(F.col("before") / size)).drop("before", "total"), "blocks")
    kind = d.schema[key].dataType.simpleString()
    own = stage(d.groupBy("__b").applyInPandas(lambda g: _closest(g, g, key, columns, k, True).assign(b=g["__b"].iloc[0])[["b", key, "d", "id"]], f"b long, {key} {kind}, d double, id {kind}"), "own-block")
    full = F.when(F.count("*") < k, F.lit(float("inf"))).otherwise(F.max("d"))
    reach = own.groupBy(key).agg(full.alias("__r")).withColumnRenamed(key, "__k")
    d = stage(d.join(reach, F.col(key) == F.col("__k"), "left").withColumn("__r", F.coalesce("__r", F.lit(float("inf")))).drop("__k"), "reach")
    ends = d.groupBy("__b").agg(F.min(lead).alias("lo"), F.max(lead).alias("hi"), F.max("__r").alias("r")).orderBy("__b").toPandas()  # a row per block
    found = own.drop("b")
    if len(ends) > 1:
        blocks, lo, hi, r = (ends[c].to_numpy() for c in ("__b", "lo", "hi", "r"))
        first, last = np.searchsorted(hi, lo - r, "left"), np.searchsorted(lo, hi + r, "right") - 1
        spans = spark.createDataFrame(pd.DataFrame({"__b1": blocks, "first": first, "last": last}))
        table = spark.createDataFrame(pd.DataFrame({"__o": blocks, "place": np.arange(len(blocks)), "__lo": lo, "__hi": hi}))
        pairs = stage(spans.select("__b1", F.explode(F.sequence("first", "last")).alias("at")).join(table, F.col("at") == F.col("place")).where("__b1 <> __o").select("__b1", "__o", "__lo", "__hi"), "block-pairs")
        gap = F.greatest(F.col("__lo") - F.col(lead), F.col(lead) - F.col("__hi"), F.lit(0.0))
        asking = d.join(pairs, F.col("__b") == F.col("__b1")).where(gap <= F.col("__r") * (1 + 1e-9)).select(key, *columns, F.col("__b1").alias("b1"), F.col("__o").alias("b2"))
        # new names for the same columns: both sides of the cogroup come from d, whose columns would be ambiguous
        there = d.select(*[F.col(x).alias(x) for x in (key, *columns, "__b")])
        base = there.join(pairs.select(F.col("__b1").alias("b1"), F.col("__o").alias("b2")), F.col("__b") == F.col("b2")).drop("__b")
        visit = lambda p, q: _closest(p, q, key, columns, k, False) if len(p) and len(q) else pd.DataFrame({key: p[key].iloc[:0], "d": pd.Series(dtype=float), "id": p[key].iloc[:0]})
        found = found.unionByName(asking.groupBy("b1", "b2").cogroup(base.groupBy("b1", "b2")).applyInPandas(visit, f"{key} {kind}, d double, id {kind}"))
    best = found.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("d", "id"))).where(F.col("__n") <= k)
    return best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("neighbours"))


def local_outlier_factor(df: DataFrame, key: str, columns: list[str], k: int = 10) -> DataFrame:
    """key, lof: density of the neighbours over the row's own, from the k nearest."""
    nn = stage(nearest(df, key, columns, k), "nearest")
    kd = nn.select(F.col(key).alias("id"), F.expr(f"neighbours[least(size(neighbours), {k}) - 1].d").alias("kd"))
    edge = nn.select(key, F.explode("neighbours").alias("n")).select(key, "n.d", "n.id").join(kd, "id")
    lrd = stage(edge.groupBy(key).agg((F.count("*") / F.greatest(F.sum(F.greatest("d", "kd")), F.lit(1e-12))).alias("lrd")), "density")
    there = lrd.select(F.col(key).alias("id"), F.col("lrd").alias("other"))
    return edge.join(there, "id").groupBy(key).agg(F.avg("other").alias("other")).join(lrd, key).select(key, (F.col("other") / F.col("lrd")).alias("lof"))


def outliers(df: DataFrame, key: str, columns: list[str], contamination: float = 0.05) -> DataFrame:
    """key, score, outlier: 0.4 diagonal Mahalanobis + 0.3 nearest-neighbour distance + 0.3 LOF, each min-max scaled."""
    d = df.na.drop(subset=columns)
    st = d.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    z = d.join(st).select(key, *[F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    z = stage(z, "standardised")
    maha = z.select(key, F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))).alias("maha"))
    near = nearest(z, key, columns, 1).select(key, F.expr("neighbours[0].d").alias("near"))
    s = stage(maha.join(near, key, "left").join(local_outlier_factor(z, key, columns), key, "left"), "scores")
    ends = s.agg(*[f(c).alias(f"{n}_{c}") for c in ("maha", "near", "lof") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    unit = lambda c: F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)), F.lit(0.0))
    s = s.join(ends).select(key, (0.4 * unit("maha") + 0.3 * unit("near") + 0.3 * unit("lof")).alias("score"))
    cut = ordering.quantiles(stage(s, "scores"), "score", {"cut": 1 - contamination})
    return s.join(cut).select(key, "score", (F.col("score") > F.col("cut")).alias("outlier"))


def influence(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Leverage, Cook's distance and the change of y's variance without the row, in closed form."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    a = d.agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.var_samp("y").alias("vy"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    j = d.join(a)
    e = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    h = 1 / F.col("n") + F.pow(F.col("x") - F.col("mx"), 2) / F.col("sxx")
    mse = (F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2)
    without = ((F.col("n") - 1) * F.col("vy") - F.pow(F.col("y") - F.col("my"), 2) * F.col("n") / (F.col("n") - 1)) / (F.col("n") - 2)
    return j.select(key, h.alias("leverage"), (e * e / (2 * mse) * h / F.pow(1 - h, 2)).alias("cook"), (F.col("vy") - without).alias("variance_impact"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """ECDF and normal QQ points of the distinct values."""
    from sparkloom.operators.stats.special import normal_quantile
    from sparkloom.plans.ordering import cumulative

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return p.map(normal_quantile)

    c = cumulative(df, column)
    middle = (F.col("before") + F.col("n") / 2) / F.col("total")
    return c.select(F.col("v").alias("value"), ((F.col("before") + F.col("n")) / F.col("total")).alias("ecdf"), quantile(middle).alias("normal_quantile"))


def box_cox(df: DataFrame, column: str, lambdas: list[float] | None = None) -> DataFrame:
    """lambda, log_likelihood on a grid, the best first; needs positive values."""
    grid = lambdas or [round(-2 + 0.1 * i, 1) for i in range(41)]
    x = F.col(column).cast("double")
    d = df.where(x > 0)
    val = lambda l: F.log(x) if l == 0 else (F.pow(x, l) - 1) / l
    one = d.agg(F.count("*").alias("n"), F.sum(F.log(x)).alias("s"), *[F.var_pop(val(l)).alias(f"v{i}") for i, l in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(float(l)).alias("lambda"), (-F.col("n") / 2 * F.log(F.col(f"v{i}")) + (l - 1) * F.col("s")).alias("log_likelihood")) for i, l in enumerate(grid)])
    return one.select(F.explode(rows).alias("r")).select("r.*").orderBy(F.desc("log_likelihood"))


def time_series(df: DataFrame, order: str, x: str, period: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Trend (centred mean over 7), seasonal index by position in the period, and residual, per row."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("trend", F.avg(x).over(w.rowsBetween(-3, 3)))
    d = d.withColumn("__p", F.col("__i") % period).withColumn("__d", F.col(x) - F.col("trend"))
    s = d.groupBy(*keys, "__p").agg(F.avg("__d").alias("seasonal"))
    return d.join(s, [*keys, "__p"]).withColumn("residual", F.col("__d") - F.col("seasonal")).drop("__i", "__p", "__d")


def quality(df: DataFrame) -> DataFrame:
    """One row: the six dimensions, the weighted score, violations, duplicate rows and candidate keys.

    Consistency loses a hundredth for every column that breaks a rule: numbers beyond a million on either side, text
    over 1000 characters. Accuracy is the share of plausible ages in columns named so, timeliness a fixed score: a table
    doesn't say how old it is. Distinct counts come from the counted values of all columns in one shuffle.
    """
    cols = [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]
    n = F.count("*")
    numeric, text = (([c for c in cols if isinstance(df.schema[c].dataType, t)]) for t in (T.NumericType, T.StringType))
    share = lambda ok, c: F.count_if(ok) / F.greatest(F.count(c), F.lit(1))
    checks = [share(F.col(c).rlike(EMAIL if "mail" in c.lower() else URL), c) for c in text if any(w in c.lower() for w in ("mail", "url", "website"))]
    checks += [share(F.col(c).between(0, 100), c) for c in numeric if "percent" in c.lower()]
    ages = [share(F.col(c).between(0, OLDEST), c) for c in numeric if "age" in c.lower().split("_")]
    mean = lambda x, none: sum(x[1:], x[0]) / len(x) if x else F.lit(none)
    broken = [F.coalesce(F.max(F.abs(F.col(c).cast("double"))) > EXTREME, F.lit(False)) for c in numeric] + [F.coalesce(F.max(F.length(c)) > LONG_TEXT, F.lit(False)) for c in text]
    complete = sum((F.count(c) for c in cols), F.lit(0)) / F.greatest(n * len(cols), F.lit(1))
    one = df.agg(n.alias("n"), complete.alias("completeness"), mean(checks, 1.0).alias("validity"), mean(ages, ACCURACY).alias("accuracy"), sum((x.cast("long") for x in broken), F.lit(0).cast("long")).alias("violations"))
    # every column's distinct values by hash pairs, counted once for all columns
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("h"), F.hash(c).alias("g"), F.col(c).isNull().alias("none")) for i, c in enumerate(cols)])).alias("v")
    per = df.select(values).select("v.*").where("NOT none").groupBy("i", "h", "g").agg(F.count("*").alias("k")).groupBy("i").agg(F.count("*").alias("d"), F.sum("k").alias("k"))
    rows = df.groupBy(F.xxhash64(*cols).alias("h"), F.hash(*cols).alias("g")).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicates"))
    found = per.agg(F.collect_list(F.struct("i", "d")).alias("per"))  # an entry a column
    keyed = lambda i: F.exists("per", lambda x: (x["i"] == i) & (x["d"] == F.col("n")))
    keys = F.filter(F.array(*[F.when(keyed(i) & (F.col("n") > 0), F.lit(c)) for i, c in enumerate(cols)]), lambda x: x.isNotNull())
    out = one.join(rows).join(found).select("n", "completeness", (1 - F.least(F.lit(1.0), F.col("violations") / 100.0)).alias("consistency"), "accuracy", F.lit(TIMELINESS).alias("timeliness"), "validity", (1 - F.col("duplicates") / F.greatest(F.col("n"), F.lit(1))).alias("uniqueness"), "violations", "duplicates", keys.alias("candidate_keys"))
    return out.withColumn("score", sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)))


def insights(summary_rows: list, correlation_rows: list, quality_row) -> list[str]:
    """Rule-based sentences from collected reports (a row per column or pair)."""
    out = []
    for r in summary_rows:
        total = r.n + r.nulls
        if total and r.nulls / total > 0.2:
            out.append(f"{r.column} is missing in {r.nulls / total:.0%} of rows: impute or drop it")
        if abs(r.skewness or 0) > 1:
            out.append(f"{r.column} is skewed ({r.skewness:.2f}): try a log or Box-Cox transform")
        if r.n and r.outliers / r.n > 0.05:
            out.append(f"{r.column} has {r.outliers} values beyond 1.5 IQR")
        if r.distinct == 1:
            out.append(f"{r.column} is constant")
    out += [f"{r.a} and {r.b} are strongly related (r = {r.pearson:.2f})" for r in correlation_rows if abs(r.pearson) >= 0.8]
    if quality_row and quality_row.duplicates:
        out.append(f"{quality_row.duplicates} rows repeat another row")
    return out


def report(df: DataFrame, kind: str = "MARKDOWN") -> str:
    """A report frame (a few rows) as JSON, Markdown, HTML or CSV text."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    if kind.upper() == "JSON":
        return json.dumps(rows, default=str, indent=1)
    if kind.upper() == "HTML":
        return df.toPandas().to_html(index=False)
    if kind.upper() == "CSV":
        return df.toPandas().to_csv(index=False)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r[c]) for c in df.columns) + " |" for r in rows])


def save_report(df: DataFrame, path: str) -> None:
    """By the file's ending: .json, .md, .html, .csv."""
    kind = {"json": "JSON", "md": "MARKDOWN", "html": "HTML", "csv": "CSV"}[path.rsplit(".", 1)[-1].lower()]
    write_text(df.sparkSession, path, report(df, kind))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables' summaries side by side on their common numeric columns."""
    cols = [c for c in numeric_columns(a) if c in numeric_columns(b)]
    left, right = summary(a, cols), summary(b, cols)
    return left.select("column", *[F.col(m).alias(f"a_{m}") for m in ("n", "mean", "stddev")]).join(right.select("column", *[F.col(m).alias(f"b_{m}") for m in ("n", "mean", "stddev")]), "column")


def comprehensive(df: DataFrame, columns: list[str]) -> DataFrame:
    """section, item, measure, value: summary of every column, every pair's correlation, and quality, as one report."""

    def long(d: DataFrame, section: str, item: Column, skip: tuple[str, ...]) -> DataFrame:
        values = [c for c in d.columns if c not in skip and isinstance(d.schema[c].dataType, T.NumericType)]
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in values])).alias("v")
        return d.select(F.lit(section).alias("section"), item.alias("item"), rows).select("section", "item", "v.*")

    out = long(quality(df), "quality", F.lit("table"), ())
    if columns:
        out = long(summary(df, columns), "summary", F.col("column"), ("column",)).union(out)
    if len(columns) > 1:
        out = out.union(long(correlations(df, columns), "correlation", F.concat_ws(", ", "a", "b"), ("a", "b")))
    return out


def analyze(df: DataFrame, kind: str = "SUMMARY", target: str | None = None, features: list[str] | None = None, key: str | None = None, **options: object) -> DataFrame:
    """ANALYZE DATA by type."""
    kind = kind.upper()
    cols = features or numeric_columns(df)
    if kind == "SUMMARY":
        return summary(df, cols)
    if kind == "COMPREHENSIVE":
        return comprehensive(df, cols)
    if kind == "CORRELATION":
        return correlations(df, cols)
    if kind == "IMPORTANCE":
        if not target:
            raise ValueError("IMPORTANCE needs a TARGET")
        return importance(df, target, [c for c in cols if c != target])
    if kind == "CLUSTERING":
        return clusters(df, cols, options.get("clusters"))[1]
    if kind == "OUTLIER":
        return outliers(df.withColumn("__key", F.monotonically_increasing_id()) if key is None else df, key or "__key", cols, float(options.get("contamination", 0.05)))
    if kind == "DISTRIBUTION":
        return distribution(df, target or cols[0])
    if kind == "TIMESERIES":
        times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType)]
        time, value = options.get("time") or (times[0] if times else None), target or next((c for c in cols if c != options.get("time")), None)
        if time is None or value is None:
            raise ValueError("TIMESERIES needs a time column (WITH (time = c)) and a number")
        return time_series(df, str(time), value, int(options.get("period", 7))).select(str(time), value, "trend", "seasonal", "residual")
    if kind == "QUALITY":
        return quality(df)
    raise ValueError(f"unknown analysis {kind}; one of {', '.join(TYPES)}")
