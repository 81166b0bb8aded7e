"""Global order without one task that sees all rows.

Rows are range-partitioned and staged; each partition sorts and counts its own, and a table of one row per partition
carries the running totals across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.staging import stage


def matched(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """a joined with b on the keys, NULL equal to NULL; without keys b is one row. The keys are a's."""
    if not keys:
        return a.join(b) if how == "inner" else a.join(b, how=how, on=F.lit(True))
    there = b.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & a[k].eqNullSafe(there[f"__k{i}"])
    return a.join(there, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def running(df: DataFrame, order: Sequence[Column | str], weight: Column | None = None, before: str = "before", total: str = "total", keys: Sequence[str] = ()) -> DataFrame:
    """Adds the weights (1 a row) of all rows before this one in the order, and of all rows; with keys, within each key.

    Rows that tie in the order get an arbitrary order among themselves: make the order unique where that matters. A key
    with most of the rows is spread over as many partitions as any other rows.
    """
    w = F.lit(1) if weight is None else weight
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = [F.col(k) for k in keys] + cols
    kind = df.select(w.alias("w")).schema[0].dataType
    parts = stage(df.withColumn("__w", w.cast("double" if isinstance(kind, T.FractionalType) else "long")).repartitionByRange(*ranges).withColumn("__p", F.spark_partition_id()), "ranged")
    sums = parts.groupBy("__p", *keys).agg(F.sum("__w").alias("__s"))
    # a row per partition and key in it: a key spans many partitions or a partition many keys, not both
    of_key = Window.partitionBy(*keys)
    sums = sums.select("__p", *keys, (F.sum("__s").over(of_key.orderBy("__p")) - F.col("__s")).alias("__o"), F.sum("__s").over(of_key).alias(total))
    inside = F.sum("__w").over(Window.partitionBy("__p", *keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w")
    return matched(parts.withColumn("__i", inside), sums, ["__p", *keys]).withColumn(before, F.col("__i") + F.col("__o")).drop("__i", "__o", "__w", "__p")


def quantiles(df: DataFrame, column: str, ps: dict[str, float], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """keys and exact quantiles by name: linear interpolation at p * (n - 1), as PERCENTILE_CONT has it.

    No task sees all values of a group: distinct values are counted, put in order by ranges and picked by their places.
    With a weight, the rows are distinct values already and it has their counts.
    A group without values has no row; without keys there is one row, NULL if there is no value.
    """
    d = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("__v"), *([] if weight is None else [F.col(weight).alias("__n")]))
    counts = d.groupBy(*keys, "__v").agg(F.count("*").alias("__n")) if weight is None else d
    placed = running(counts, ["__v"], F.col("__n"), "__before", "__total", keys)
    place = lambda p: F.lit(float(p)) * (F.col("__total") - 1)
    at = lambda r: F.max(F.when((F.col("__before") <= r) & (r < F.col("__before") + F.col("__n")), F.col("__v")))
    picked = []
    for i, p in enumerate(ps.values()):
        picked += [at(F.floor(place(p))).alias(f"__l{i}"), at(F.ceil(place(p))).alias(f"__h{i}")]
    got = placed.groupBy(*keys).agg(F.max("__total").alias("__total"), *picked)
    share = lambda p: place(p) - F.floor(place(p))
    return got.select(*keys, *[(F.col(f"__l{i}") + share(p) * (F.col(f"__h{i}") - F.col(f"__l{i}"))).alias(k) for i, (k, p) in enumerate(ps.items())])


def at_places(df: DataFrame, column: str, places: dict[str, int]) -> DataFrame:
    """One row: the values at places (0: the smallest) of the column in order, NULL beyond its end."""
    c = cumulative(df, column)
    return c.agg(*[F.max(F.when((F.col("before") <= k) & (F.lit(k) < F.col("before") + F.col("n")), F.col("v"))).alias(name) for name, k in places.items()])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """v, n: the distinct values with their counts, combined on the map side."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))


def cumulative(df: DataFrame, column: str) -> DataFrame:
    """v, n, before, total: how many values are below each distinct value."""
    return running(value_counts(df, column), ["v"], F.col("n"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the average rank of the column; ties share the mean of their places. NULL stays NULL."""
    ranks = cumulative(df, column).select(F.col("v").alias("__v"), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(column).cast("double") == F.col("__v"), "left").drop("__v")
