"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import forget, saved


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that a link (a, b) of longs names.

    Every node's edges are pointed at the smallest neighbour, once among all neighbours and once among the smaller
    ones; neighbours are never gathered, only their minimum is, so a node with very many of them has no effect
    beyond a skewed join, which Spark splits.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = saved(pairs.where("u > v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = saved(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, saved(small, "links")
        forget(old)
        forget(large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = saved(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
    forget(edges)
    return out
