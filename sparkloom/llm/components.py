"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are one shuffle each and never gather a node's neighbours: a step only needs a node's smallest
neighbour, which partial aggregation finds, so a hub with a third of all edges is no hot task. Every round is
written to the shared folder, which ends the lineage; rounds grow with the logarithm of the longest chain.

Rows with a null end are ignored; loops and repeated edges are allowed; the result of no edges is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_staged, stage


def _star(both: DataFrame) -> DataFrame:
    """With (u, v) in either direction: the smallest of u and its neighbours, joined back onto u's edges."""
    low = both.groupBy("u").agg(F.min("v").alias("lv")).select(F.col("u").alias("k"), F.least("u", "lv").alias("m"))
    return both.join(low, both.u == low.k).select("u", "v", "m")


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, component: for every node of an edge the smallest node that it is linked with."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large star: neighbours above a node go to the smallest of its whole neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = stage(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        # settled once the edges stay: equal counts and equal sums of edge hashes
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_staged(e)
        e = new
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.union(roots)
