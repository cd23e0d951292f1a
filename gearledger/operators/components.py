"""Connected components of a table of links, for work that falls into independent parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of the links (a, b); a component is named after its least node.

    Every node points at a node of its component that is not larger. A round looks, per node,
    at the least node that a neighbour's pointer points at, and offers it to the node itself and
    to what the node points at; then every node may also skip over its pointer. Pointers only
    fall, and the trees they form join and flatten, so the rounds grow with the logarithm of
    the longest path. Minima combine before each shuffle, so a node of very many links is no
    hot task. Null ends are not allowed.
    """
    ends = links.where("a <> b").select("a", "b").distinct()
    both = settle(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    own = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b"))
    told = settle(own.join(least, "node", "left").select("node", F.least("node", "_b").alias("up")))
    while True:
        over = told.select(F.col("node").alias("_n"), F.col("up").alias("top"))
        seen = settle(told.join(over, F.col("up") == F.col("_n")).select("node", "up", "top"))
        near = both.join(seen.select(F.col("node").alias("b"), "top"), "b").groupBy("a").agg(F.min("top").alias("least"))
        known = seen.join(near.withColumnRenamed("a", "node"), "node", "left").withColumn("least", F.coalesce("least", "top"))
        offers = known.select(F.inline(F.array(
            F.struct("node", F.least("up", "top", "least").alias("up")), F.struct(F.col("up").alias("node"), F.col("least").alias("up")),
        )))
        after = settle(offers.groupBy("node").agg(F.min("up").alias("up")))
        moved = after.join(told.withColumnRenamed("up", "_was"), "node").where("up <> _was")
        told = after
        if moved.isEmpty():
            return told.select("node", F.col("up").alias("component"))
