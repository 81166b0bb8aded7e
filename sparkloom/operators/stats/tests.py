"""Hypothesis tests. Sums come from one aggregation; tails from the driver's special functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.stats import special as S
from sparkloom.operators.stats.descriptive import kurtosis, skewness
from sparkloom.plans.ordering import average_ranks, cumulative


def _out(spark, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


def jarque_bera(df: DataFrame, x: str) -> DataFrame:
    n, s, k = F.count(x), skewness(F.col(x)), kurtosis(F.col(x))
    jb = n / 6 * (s * s + k * k / 4)
    return df.agg(jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"))


def _edf(df: DataFrame, x: str, name: str) -> tuple[DataFrame, dict[str, float]]:
    """Distinct values with places and the fitted distribution's CDF, evaluated in Arrow batches."""
    c = F.col(x).cast("double")
    m = df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(F.when(c > 0, F.log(F.when(c > 0, c)))).alias("lm"), F.stddev_samp(F.when(c > 0, F.log(F.when(c > 0, c)))).alias("ls")).first()
    p = {"normal": {"mu": m.mean, "sigma": m.sd or 1.0}, "lognormal": {"mu": m.lm or 0.0, "sigma": m.ls or 1.0}, "exponential": {"rate": 1 / m.mean if m.mean else 1.0}, "uniform": {"low": m.lo, "high": m.hi if m.hi != m.lo else m.lo + 1}}[name]

    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:
        return v.map(lambda z: S.cdf(name, z, **p))

    return cumulative(df, x).withColumn("f", cdf("v")), p


def kolmogorov_smirnov(df: DataFrame, x: str, name: str = "normal") -> DataFrame:
    e, _ = _edf(df, x, name)
    up, lo = (F.col("before") + F.col("n")) / F.col("total"), F.col("before") / F.col("total")
    r = e.agg(F.max(F.greatest(F.abs(up - F.col("f")), F.abs(lo - F.col("f")))).alias("d"), F.max("total").alias("n")).first()
    z = (math.sqrt(r.n) + 0.12 + 0.11 / math.sqrt(r.n)) * r.d
    p = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 101)) if z > 0.2 else 1.0
    return _out(df.sparkSession, statistic=r.d, p_value=min(1.0, max(0.0, p)))


def anderson_darling(df: DataFrame, x: str, name: str = "normal") -> DataFrame:
    """A squared; a tied value's places are summed in closed form."""
    e, _ = _edf(df, x, name)
    n, a, t = F.col("n").cast("double"), F.col("before").cast("double"), F.col("total").cast("double")
    f = F.least(F.greatest(F.col("f"), F.lit(1e-15)), F.lit(1 - 1e-15))
    odd = n * n + 2 * a * n  # sum of 2i - 1
    even = n * (2 * t + 1) - (n * (2 * a + n + 1))  # sum of 2(t - i) + 1
    return e.agg((-F.max(t) - F.sum((odd * F.log(f) + even * F.log(1 - f)) / t)).alias("statistic"))


def cramer_von_mises(df: DataFrame, x: str, name: str = "normal") -> DataFrame:
    e, _ = _edf(df, x, name)
    n, a, t, f = F.col("n").cast("double"), F.col("before").cast("double"), F.col("total").cast("double"), F.col("f")
    # sum over i = a+1 .. a+n of ((2i - 1) / 2t - f)^2
    s1 = n * (2 * a + n) / (2 * t)
    hi, lo = a + n, a
    s2 = (hi * (4 * hi * hi - 1) - lo * (4 * lo * lo - 1)) / (3 * 4 * t * t)
    return e.agg((F.max(1 / (12 * t)) + F.sum(s2 - 2 * f * s1 + n * f * f)).alias("statistic"))


def shapiro_wilk(df: DataFrame, x: str) -> DataFrame:
    """W with Royston-style weights m / |m| from Blom scores, over all values by their places."""
    c = cumulative(df, x)

    def scores(batches):
        def over(a: int, n: int, t: int) -> tuple[float, float]:
            """Sums of the scores of places a + 1 to a + n and of their squares: term by term, or of many ties the integral."""
            if n <= 4096:
                z = [S.normal_quantile((i - 0.375) / (t + 0.25)) for i in range(a + 1, a + n + 1)]
                return sum(z), sum(x * x for x in z)
            ends = [min(max((a + k + 0.125) / (t + 0.25), 1e-300), 1 - 1e-16) for k in (0, n)]
            z = [S.normal_quantile(p) for p in ends]
            density = [math.exp(-x * x / 2) / math.sqrt(2 * math.pi) for x in z]
            return (t + 0.25) * (density[0] - density[1]), (t + 0.25) * ((ends[1] - z[1] * density[1]) - (ends[0] - z[0] * density[0]))

        for b in batches:
            both = [over(int(a), int(n), int(t)) for a, n, t in zip(b.before, b.n, b.total)]
            yield pd.DataFrame({"v": b.v, "n": b.n, "m": [x[0] for x in both], "q": [x[1] for x in both]})

    s = c.mapInPandas(scores, "v double, n long, m double, q double")
    w = F.pow(F.sum(F.col("v") * F.col("m")), 2) / F.nullif(F.sum("q") * (F.sum(F.col("n") * F.col("v") * F.col("v")) - F.pow(F.sum(F.col("n") * F.col("v")), 2) / F.sum("n")), F.lit(0.0))
    r = s.agg(F.coalesce(w, F.lit(1.0)).alias("w"), F.sum("n").alias("n")).first()
    n, w = float(r.n or 0), min(float(r.w), 1 - 1e-12)
    if n < 3:
        return _out(df.sparkSession, statistic=1.0, p_value=1.0)
    ln = math.log(n)
    mu, sigma = (-1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3), math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return _out(df.sparkSession, statistic=w, p_value=1 - S.normal_cdf((math.log(1 - w) - mu) / sigma))


def _two(df: DataFrame, x: str, group: str, a: object, b: object):
    g = lambda k: F.when(F.col(group) == F.lit(k), F.col(x).cast("double"))
    return df.agg(*[f(g(k)).alias(n + s) for k, s in ((a, "a"), (b, "b")) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))]).first()


def t_test(df: DataFrame, x: str, group: str, a: object, b: object, equal_variance: bool = False) -> DataFrame:
    """Pooled or Welch statistic, its degrees of freedom and two-sided p."""
    r = _two(df, x, group, a, b)
    if equal_variance:
        nu = r.na + r.nb - 2
        se = math.sqrt(((r.na - 1) * r.va + (r.nb - 1) * r.vb) / nu * (1 / r.na + 1 / r.nb))
    else:
        ua, ub = r.va / r.na, r.vb / r.nb
        se, nu = math.sqrt(ua + ub), (ua + ub) ** 2 / (ua**2 / (r.na - 1) + ub**2 / (r.nb - 1))
    t = (r.ma - r.mb) / se if se else 0.0
    return _out(df.sparkSession, statistic=t, df=nu, p_value=2 * (1 - S.student_cdf(abs(t), nu)))


def paired_t_test(df: DataFrame, x: str, y: str) -> DataFrame:
    d = F.col(x) - F.col(y)
    r = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
    t = r.m / (r.s / math.sqrt(r.n)) if r.s else 0.0
    return _out(df.sparkSession, statistic=t, df=r.n - 1, p_value=2 * (1 - S.student_cdf(abs(t), r.n - 1)))


def f_test(df: DataFrame, x: str, group: str, a: object, b: object) -> DataFrame:
    r = _two(df, x, group, a, b)
    f = r.va / r.vb if r.vb else math.inf
    return _out(df.sparkSession, statistic=f, df1=r.na - 1, df2=r.nb - 1)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categorical columns: statistic, degrees of freedom, p."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    c = c.withColumn("ra", F.sum("o").over(Window.partitionBy(a))).withColumn("rb", F.sum("o").over(Window.partitionBy(b))).withColumn("t", F.sum("o").over(Window.partitionBy()))
    # cells that don't occur count their expectation: sum e over all cells is t
    e = F.col("ra") * F.col("rb") / F.col("t")
    r = c.agg(F.sum(F.pow(F.col("o") - e, 2) / e - e).alias("s"), F.max("t").alias("t"), F.countDistinct(a).alias("na"), F.countDistinct(b).alias("nb")).first()
    nu = (r.na - 1) * (r.nb - 1)
    stat = r.s + r.t
    return _out(df.sparkSession, statistic=stat, df=nu, p_value=S.chi2_tail(stat, nu) if nu else 1.0)


def anova(df: DataFrame, x: str, group: str) -> DataFrame:
    """One-way F; infinite when no group varies."""
    g = df.where(F.col(x).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count("*")).alias("w"))
    r = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("w").alias("w"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("b")).first()
    d1, d2 = r.k - 1, r.n - r.k
    f = (r.b / d1) / (r.w / d2) if r.w and d1 and d2 else math.inf
    return _out(df.sparkSession, statistic=f, df1=d1, df2=d2, p_value=S.f_tail(f, d1, d2) if math.isfinite(f) else 0.0)


def mann_whitney(df: DataFrame, x: str, group: str, a: object, b: object) -> DataFrame:
    """U of the first group with tie-corrected normal approximation."""
    d = average_ranks(df.where(F.col(group).isin(a, b) & F.col(x).isNotNull()).select(F.col(x).alias("x"), F.col(group).alias("g")), "x", "r")
    ties = d.groupBy("x").count().agg(F.sum(F.pow("count", 3) - F.col("count")).alias("t")).first().t
    s = {r.g: (r.n, r.s) for r in d.groupBy("g").agg(F.count("*").alias("n"), F.sum("r").alias("s")).collect()}
    (na, ra), (nb, _) = s[a], s[b]
    u, n = ra - na * (na + 1) / 2, na + nb
    sd = math.sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (u - na * nb / 2) / sd if sd else 0.0
    return _out(df.sparkSession, statistic=u, z=z, p_value=2 * (1 - S.normal_cdf(abs(z))))


def kruskal_wallis(df: DataFrame, x: str, group: str) -> DataFrame:
    """H on average ranks with tie correction."""
    d = average_ranks(df.where(F.col(x).isNotNull()).select(F.col(x).alias("x"), F.col(group).alias("g")), "x", "r")
    ties = d.groupBy("x").count().agg(F.sum(F.pow("count", 3) - F.col("count")).alias("t")).first().t
    r = d.groupBy("g").agg(F.count("*").alias("n"), F.sum("r").alias("s")).agg(F.sum(F.pow("s", 2) / F.col("n")).alias("q"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    n = r.n
    h = (12 / (n * (n + 1)) * r.q - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return _out(df.sparkSession, statistic=h, df=r.k - 1, p_value=S.chi2_tail(h, r.k - 1))


def adf(df: DataFrame, order: str, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Dickey-Fuller without lags: regression of the difference on the level; stationary below the 5 % critical value."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.select(*keys, F.lag(x).over(w).cast("double").alias("l"), F.col(x).cast("double").alias("v")).where("l IS NOT NULL").withColumn("d", F.col("v") - F.col("l"))
    n, b = F.count("*"), F.regr_slope("d", "l")
    sse = F.regr_syy("d", "l") - b * F.regr_sxy("d", "l")
    se = F.sqrt(F.greatest(sse, F.lit(0.0)) / F.nullif(n - 2, F.lit(0)) / F.nullif(F.regr_sxx("d", "l"), F.lit(0.0)))
    t = F.coalesce(b / F.nullif(se, F.lit(0.0)), F.lit(0.0))
    out = d.groupBy(*keys).agg(t.alias("statistic"), n.alias("n"))
    s = F.col("statistic")
    return out.withColumn("p_value", F.when(s < -3.43, 0.01).when(s < -2.86, 0.05).when(s < -2.57, 0.1).otherwise(0.5)).withColumn("stationary", s < -2.86)


def kpss(df: DataFrame, order: str, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Level KPSS with Bartlett bandwidth 4 (n / 100)^(2/9); a series is one window partition."""
    sizes = df.groupBy(*keys).agg(F.count(x).alias("__n"), F.avg(x).alias("__m"))
    both = df.join(sizes, list(keys)) if keys else df.join(sizes)
    w = Window.partitionBy(*keys).orderBy(order)
    d = both.where(F.col(x).isNotNull()).withColumn("e", F.col(x) - F.col("__m")).withColumn("s", F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    most = int(sizes.agg(F.max(F.floor(4 * F.pow(F.col("__n") / 100, 2 / 9)))).first()[0] or 0)
    n = F.max("__n").cast("double")
    h = F.floor(4 * F.pow(n / 100, 2 / 9))
    for k in range(1, most + 1):
        d = d.withColumn(f"l{k}", F.col("e") * F.lag("e", k).over(w))
    var = F.sum(F.col("e") * F.col("e")) / n
    for k in range(1, most + 1):
        var = var + F.when(h >= k, 2 * (1 - k / (h + 1)) * F.coalesce(F.sum(f"l{k}"), F.lit(0.0)) / n).otherwise(0.0)
    stat = F.coalesce(F.sum(F.col("s") * F.col("s")) / (n * n) / F.nullif(var, F.lit(0.0)), F.lit(0.0))
    return d.groupBy(*keys).agg(stat.alias("statistic")).withColumn("stationary", F.col("statistic") < 0.463)


def grubbs(df: DataFrame, x: str, alpha: float = 0.05) -> DataFrame:
    """The most extreme value on each side against the critical value."""
    r = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    n = r.n
    lo, hi = 0.0, 200.0
    for _ in range(200):  # t quantile at alpha / 2n by bisection
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - S.student_cdf(mid, n - 2) > alpha / (2 * n) else (lo, mid)
    crit = (n - 1) / math.sqrt(n) * math.sqrt(lo * lo / (n - 2 + lo * lo))
    rows = [(side, float(v), abs(v - r.m) / r.s if r.s else 0.0, crit) for side, v in (("low", r.lo), ("high", r.hi))]
    return df.sparkSession.createDataFrame([(*x, x[2] > x[3]) for x in rows], "side string, value double, g double, critical double, outlier boolean")


def dixon(df: DataFrame, x: str) -> DataFrame:
    """Gap over range of the extreme values, for 3 to 30 values; critical values at 95 % up to 30."""
    # --- fixed values: Dixon r10 critical values at 95 % for n = 3 .. 30 ---
    critical = (0.970, 0.829, 0.710, 0.625, 0.568, 0.526, 0.493, 0.466, 0.444, 0.426, 0.410, 0.396, 0.384, 0.374, 0.365, 0.356, 0.349, 0.342, 0.337, 0.331, 0.326, 0.321, 0.317, 0.312, 0.308, 0.305, 0.301, 0.298)
    v = sorted(r[0] for r in df.where(F.col(x).isNotNull()).select(F.col(x).cast("double")).limit(31).collect())
    if not 3 <= len(v) <= 30:
        raise ValueError("Dixon's test takes 3 to 30 values")
    span = v[-1] - v[0]
    c = critical[len(v) - 3]
    rows = [("low", v[0], (v[1] - v[0]) / span if span else 0.0, c), ("high", v[-1], (v[-1] - v[-2]) / span if span else 0.0, c)]
    return df.sparkSession.createDataFrame([(*r, r[2] > r[3]) for r in rows], "side string, value double, q double, critical double, outlier boolean")

