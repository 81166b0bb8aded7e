"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words; every document of it should be taken target/size times on average. The
whole part is taken as such; the fractional parts x (of documents of s words) are rounded dependently: two documents
trade a mass of words, one up and one down, until one of the two is integral. The direction is drawn so that every
x keeps its expectation, and the words s*x of the pair stay the same, so a source ends within one document of its
target. Each source's documents are dealt into cells of bounded size; a cell leaves one document undecided, and the
undecided ones are paired again, cells by cells, in a reduction tree down to one per source, which a last draw decides.

Draws come from a generator seeded by source, level and cell, over rows in content order: reruns agree.

Defined results: null text has size 0 and is taken 0 times its size whatever is drawn; null source is a source, the
last one; null and repeated identifiers are rows like any other; a source without words has target 0; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import ship, stage
from sparkloom.plans.ordering import running

#: Rows of a cell, about.
CELL = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """row, id, source, size in words, and a hash of the text; narrow, and staged so that row stays what it is."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"))
    return stage(out, "sizes")


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, n_rows and target of each source.

    Sources in code point order, null last, take the weights in turn and share `share` times all words; a target
    stops at `cap` times its source's words and the excess is shared among the others by weight, until none is above.
    Sorted by cap per weight, the sources that stop come first: running sums over the sources give the rest's rate.
    """
    per = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "sources")
    budget = float(share) * float(per.agg(F.sum("source_size")).first()[0] or 0)
    # places and sums by ranges of the order: a source may be a host, so no task has all of them
    last = F.col("source").isNull()
    placed = running(per, [last, "source"], before="place", total="sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = [F.col("most") / F.col("w"), last, "source"]
    sums = running(running(placed, order, F.col("most"), "stopped", "all_most"), order, F.col("w"), "passed_w", "all_w")
    rated = stage(sums.withColumn("rate", (F.lit(budget) - F.col("stopped")) / (F.col("all_w") - F.col("passed_w"))).withColumn("stops", F.expr("w * rate >= most")), "rates")
    final = rated.where("NOT stops").agg(F.min("rate")).first()[0]
    return rated.select("source", "source_size", "n_rows", F.when(F.col("stops"), F.col("most")).otherwise(F.col("w") * F.lit(final).cast("double")).alias("target"))


def round_cell(x: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the fractional x of documents with s > 0 words; returns x and the place left undecided (-1: none)."""
    x = x.copy()
    draws = rng.random(len(x))
    open_at = -1
    for j in range(len(x)):
        if not 0.0 < x[j] < 1.0:
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        up = min((1 - x[i]) * s[i], x[j] * s[j])
        down = min(x[i] * s[i], (1 - x[j]) * s[j])
        if draws[j] * (up + down) < down:
            full = (1 - x[i]) * s[i] <= x[j] * s[j]  # i reaches one first
            x[i], x[j] = (1.0, x[j] - up / s[j]) if full else (x[i] + up / s[i], 0.0)
        else:
            full = x[i] * s[i] <= (1 - x[j]) * s[j]  # i reaches zero first
            x[i], x[j] = (0.0, x[j] + down / s[j]) if full else (x[i] - down / s[i], 1.0)
        for k in (i, j):
            if x[k] < 1e-12 or x[k] > 1 - 1e-12:
                x[k] = round(x[k])
        open_at = i if 0.0 < x[i] < 1.0 else j if 0.0 < x[j] < 1.0 else -1
    return x, open_at


def mix(sized: DataFrame, shares: DataFrame, seed: int = 1) -> DataFrame:
    """row, id, source, size, source_size, target and copies: how often the mix takes each row."""
    spark = sized.sparkSession
    ship(spark)
    cell_rows = CELL
    keyed = sized.withColumn("sk", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    # a row per source: staged, so that its size is known before the join is planned
    per = stage(shares, "shares").select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("k"), "source_size", "target", F.ceil(F.col("n_rows") / cell_rows).alias("cells"))
    # rows that agree in identifier and text share a cell, unless they'd fill it: those are spread by row
    many = sized.groupBy("id", "tie").agg(F.count("*").alias("m")).where(F.col("m") > cell_rows).select(F.xxhash64("id", "tie").alias("crowd")).distinct()
    rows = keyed.join(per, keyed.sk == per.k).drop("k").withColumn("hash", F.xxhash64("id", "tie"))
    rows = rows.join(many, rows.hash == many.crowd, "left")
    rows = rows.withColumn("cell", F.expr("pmod(IF(crowd IS NULL, hash, xxhash64(hash, row)), cells)")).drop("crowd", "cells")
    rows = rows.withColumn("p", F.expr("IF(source_size = 0, 0D, target / source_size)"))
    rows = rows.withColumn("whole", F.expr("CAST(floor(p + 1e-9) AS INT)")).withColumn("x", F.expr("greatest(p - whole, 0D)"))
    # a document without words moves no words: an own draw decides it
    rows = rows.withColumn("x", F.expr(f"CASE WHEN x < 1e-9 THEN 0D WHEN size = 0 THEN IF(pmod(xxhash64(hash, {int(seed)}), 1000003) < x * 1000003, 1D, 0D) ELSE x END"))
    kept = ["row", "id", "source", "size", "source_size", "target", "whole"]
    schema = sized.sparkSession.createDataFrame([], rows.select(*kept, "sk", "hash", "cell", "x").schema).schema

    def cell(level: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "hash", "row"], ascending=[False, True, True], kind="stable", ignore_index=True)
            rng = np.random.default_rng([seed, level, zlib.crc32(key[0].encode()), int(key[1])])
            x, _ = round_cell(pdf["x"].to_numpy(float), pdf["size"].to_numpy(float), rng)
            pdf["x"] = x
            return pdf

        return run

    level, done, current = 0, [], rows.select(*kept, "sk", "hash", "cell", "x")
    while True:
        # dealt by source and cell: a hot source's cells go to as many tasks as there are
        current = stage(current.repartition("sk", "cell").groupBy("sk", "cell").applyInPandas(cell(level), schema), "rounded")
        undecided = current.where("x > 0 AND x < 1")
        done.append(current.where("x = 0 OR x = 1"))
        most = undecided.groupBy("sk").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            last = F.expr(f"IF(pmod(xxhash64(hash, {int(seed)}, 7), 1000003) < x * 1000003, 1D, 0D)")
            done.append(undecided.withColumn("x", last))
            break
        level += 1
        current = undecided.withColumn("cell", F.expr(f"cell DIV {cell_rows}"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*kept[:-1], F.expr("whole + CAST(x AS INT)").alias("copies"))


def mixed_rows(docs: DataFrame, mixed: DataFrame, row_col: str) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    times = mixed.where("copies > 0").select(F.col("row").alias("__row"), F.col("copies").alias("__copies"))
    # times has a row per document: the same sort-merge plan at every size, never a broadcast that stops fitting
    both = docs.join(times.hint("merge"), docs[row_col] == times["__row"])
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__row", "__copies", "__copy", row_col)
