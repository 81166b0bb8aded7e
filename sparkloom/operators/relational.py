"""Relational operators: thin builders that leave the physical plan to Catalyst and adaptive execution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F

from sparkloom.plans.staging import stage

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def project(df: DataFrame, *columns: str | Column, aliases: dict[str, str] | None = None) -> DataFrame:
    """Column list with optional renames; '*' keeps all."""
    aliases = aliases or {}
    return df.select(*[F.col(c).alias(aliases[c]) if isinstance(c, str) and c in aliases else c for c in columns])


def where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; NULL drops."""
    return df.filter(predicate)


def join(left: DataFrame, right: DataFrame, on: Column | str | Sequence[str], how: str = "inner") -> DataFrame:
    """Any boolean condition; equality parts become the join keys. No broadcast is forced: the size decides."""
    return left.join(right, on if isinstance(on, Column | str) else list(on), JOINS[how])


def join_chain(first: DataFrame, *steps: tuple[DataFrame, Column | str | Sequence[str], str]) -> DataFrame:
    """Left-deep joins in the order given; cost-based reordering is the optimizer's."""
    for right, on, how in steps:
        first = join(first, right, on, how)
    return first


def group(df: DataFrame, keys: Sequence[str | Column], aggregates: dict[str, Column], having: Column | None = None) -> DataFrame:
    """GROUP BY with named aggregates and HAVING over their names; no keys: one row."""
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out if having is None else out.filter(having)


def grouping_sets(df: DataFrame, kind: str, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """cube or rollup over the keys."""
    return getattr(df, kind)(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def top_k(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET: a bounded heap per partition, never a full sort."""
    out = df.orderBy(*order)
    return out.offset(offset).limit(k) if offset else out.limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; the rank limit is pushed below the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= k).drop("__rn")


def distinct_sorted(df: DataFrame, *order: Column | str) -> DataFrame:
    """DISTINCT first, then ORDER BY."""
    return df.distinct().orderBy(*order)


def extract(df: DataFrame, columns: Sequence[str], predicate: Column | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Offset before the filter, limit after it."""
    out = df.select(*columns)
    out = out.offset(offset) if offset else out
    out = out if predicate is None else out.filter(predicate)
    return out if limit is None else out.limit(limit)


def over(keys: Sequence[str] = (), order: Sequence[Column | str] = ()) -> WindowSpec:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy(*order) if order else w


def whole(keys: Sequence[str], order: Sequence[Column | str]) -> WindowSpec:
    return over(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def window_functions(keys: Sequence[str], order: Sequence[Column | str], value: Column, buckets: int = 4) -> dict[str, Column]:
    """The dialect's window functions; FIRST_VALUE and LAST_VALUE look at the whole partition."""
    w, full = over(keys, order), whole(keys, order)
    return {
        "row_number": F.row_number().over(w),
        "rank": F.rank().over(w),
        "dense_rank": F.dense_rank().over(w),
        "ntile": F.ntile(buckets).over(w),
        "lag": F.lag(value, 1).over(w),
        "lead": F.lead(value, 1).over(w),
        "first_value": F.first_value(value).over(full),
        "last_value": F.last_value(value).over(full),
    }


def salted_group(df: DataFrame, keys: Sequence[str], partial: dict[str, Column], final: dict[str, Column], salts: int = 32) -> DataFrame:
    """Two-level aggregation for functions that don't combine on the map side: a hot key is first split over salts."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    first = df.withColumn("__salt", salt).groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def chunks(df: DataFrame, size: int = 10_000) -> Iterator[list[Row]]:
    """A cursor for a driver that must see rows: partition by partition, in lists of `size`, never all at once."""
    held: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def numbered_chunks(df: DataFrame, size: int = 10_000) -> DataFrame:
    """df with chunk (long): which chunk of `size` rows of that cursor a row falls into, numbered where the rows are.

    A partition counts its own rows; one row a partition carries the totals across, so the driver gets no rows at all.
    """
    d = stage(df.withColumn("__id", F.monotonically_increasing_id()), "chunks")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = d.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__p").alias("__q"), (F.sum("__n").over(Window.partitionBy().orderBy("__p")) - F.col("__n")).alias("__before"))
    return d.join(stage(before, "chunk-places"), part == F.col("__q")).withColumn("chunk", F.floor((F.col("__before") + place) / size)).drop("__id", "__q", "__before")
