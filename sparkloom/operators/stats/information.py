"""Entropy, mutual information and divergences over equal-width bins, in nats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned(df: DataFrame, x: str, bins: int, out: str) -> DataFrame:
    """Equal-width bin 0 .. bins - 1; a constant column is bin 0."""
    ends = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) / bins
    return df.where(F.col(x).isNotNull()).join(ends).withColumn(out, F.coalesce(F.least(F.floor((F.col(x) - F.col("__lo")) / width), F.lit(bins - 1)), F.lit(0)).cast("int")).drop("__lo", "__hi")


def _entropy(counts: DataFrame, name: str) -> DataFrame:
    total = Window.partitionBy()
    p = F.col("c") / F.sum("c").over(total)
    return counts.select(p.alias("p")).agg(F.sum(-F.col("p") * F.log("p")).alias(name))


def entropy(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    return _entropy(binned(df, x, bins, "b").groupBy("b").agg(F.count("*").alias("c")), "entropy")


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """I(x; y) and H(y | x) from one joint histogram; the histogram's size is bins squared."""
    both = binned(binned(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, bins, "i"), y, bins, "j")
    c = both.groupBy("i", "j").agg(F.count("*").alias("c"))
    n, ci, cj = (F.sum("c").over(w) for w in (Window.partitionBy(), Window.partitionBy("i"), Window.partitionBy("j")))
    t = c.select((F.col("c") / n).alias("p"), (ci / n).alias("pi"), (cj / n).alias("pj"))
    return t.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pi") * F.col("pj")))).alias("mutual_information"), F.sum(-F.col("p") * F.log(F.col("p") / F.col("pi"))).alias("conditional_entropy"))


def _term(p: Column, q: Column) -> Column:
    return F.when((p > 0) & (q > 0), p * F.log(p / q)).otherwise(0.0)


def divergences(p: DataFrame, q: DataFrame, key: str, weight: str) -> DataFrame:
    """Kullback-Leibler (over keys of both) and Jensen-Shannon divergence of two weight tables, normalised first."""
    share = lambda d, n: d.select(F.col(key).alias("k"), (F.col(weight) / F.sum(weight).over(Window.partitionBy())).alias(n))
    t = share(p, "p").join(share(q, "q"), "k", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    a, b = F.col("p"), F.col("q")
    m = (a + b) / 2
    return t.agg(F.sum(_term(a, b)).alias("kl"), (F.sum(_term(a, m)) / 2 + F.sum(_term(b, m)) / 2).alias("js"))
