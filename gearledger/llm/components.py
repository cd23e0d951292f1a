"""Connected components of a link table, in rounds of grouping and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the least node it reaches.

    Large-star and small-star rounds: both only need each node's least neighbour, which
    combines before the shuffle, so that a node with very many links is no hot task. The
    number of rounds grows with the logarithm of the longest path. Null ends are not allowed.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours move to the least neighbour.
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = _least(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = settle(small)
        # Done when all are stars: one least node each, which has none itself.
        ends = edges.select("a", F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up")).distinct())
        odd = ends.groupBy("a").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 OR ups = 1 AND low = 0")
        if odd.isEmpty():
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
