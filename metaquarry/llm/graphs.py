"""Connected components of links, by DataFrame operations alone: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaquarry.llm.common import drop, stored

ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links: two columns of one orderable kind. node, component: for each node that has a link, the least node it reaches.

    Each round ties a node's greater neighbours to its least one, then a node's lesser neighbours likewise, until every
    node is tied to its component's least: O(log^2 n) rounds for any shape. Neighbours are only ever reduced to their
    least, so a node with very many is summed up before the shuffle; the join that hands the least back can be split."""
    spark = links.sparkSession
    x, y = F.col(a), F.col(b)
    edges, at = stored(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    last = None
    for _ in range(ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("m", "u").alias("m"))
        large = both.join(least, both["u"] == least["of"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_at = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.select(F.col("u").alias("of"), "m"), F.expr("u = of AND v <> m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        following, next_at = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        drop(spark, at, large_at)
        edges, at = following, next_at
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
