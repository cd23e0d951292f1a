"""Exact top-k inner-product search: ball-tree branch and bound per shard.

Vectors are dealt to shards by id, queries to blocks. For each (shard, block) a ball tree is
built over the shard: a node is a centre and a radius, and no vector in it can score above
``q . centre + |q| * radius``. A queue opens nodes from the highest bound down, inner ones into
the balls below them, and a query is done as soon as the bound falls below its current k-th score:
one bound cuts a whole branch. Shards are searched in two waves: the k-th scores of the first
wave's shard are shared once with all others, which do not hear of each other's.

Scale: the queries are a stated set that meets all rows in blocks; a task holds one shard of
at most about ``SHARD_ROWS`` vectors and one block of queries, whatever the table's size. Ids are
hashed, so that no shard is hot. Each task returns at most k rows per query.

Defined results: components become floor(256 * x); vectors that are null, or hold a null or
non-finite component, take no part; vectors meet only vectors of the same length; the query's
own vec_id is never its candidate; rows that repeat an id and vector are one query, but each
is a candidate of its own; null ids are no queries and no candidates; scores beyond 64 bits
stop at the bound; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SHARD_ROWS, BLOCK_ROWS, LEAF, LEVELS = 8192, 2048, 64, 4
K, EVERY, SCALE = 5, 50, 256
FOUND = "query_id long, vec_id long, score long"
LIMIT = (-(1 << 63), (1 << 63) - 1)


class Tree:
    """Balls split at the median of their widest axis: every node has a centre and a radius.

    ``children`` are the balls ``LEVELS`` splits below, so that one call gives many bounds.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        centres, radii = [], []
        self.rows: list[np.ndarray] = [np.arange(len(points))]
        halves: list[list[int]] = []
        for node in itertools.count():
            if node == len(self.rows):
                break
            rows = self.rows[node]
            part = points[rows]
            centres.append(part.mean(axis=0))
            radii.append(np.sqrt(((part - centres[-1]) ** 2).sum(axis=1).max()))
            halves.append([])
            if len(rows) > leaf:
                axis = int((part.max(axis=0) - part.min(axis=0)).argmax()) if part.shape[1] else 0
                order = np.argsort(part[:, axis], kind="stable") if part.shape[1] else np.arange(len(rows))
                half = len(rows) // 2
                halves[node] = [len(self.rows), len(self.rows) + 1]
                self.rows += [rows[order[:half]], rows[order[half:]]]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.children = [below[:] for below in halves]
        for below in self.children:
            for _ in range(LEVELS - 1):
                below[:] = [x for node in below for x in halves[node] or [node]]

    def bounds(self, nodes: list[int], vector: np.ndarray, length: float) -> list[float]:
        """What no vector below the nodes can score above."""
        reach = length * self.radii[nodes]
        bounds = self.centres[nodes] @ vector + reach
        # Rounding must never hide a row: widen the bound a little.
        bounds += 1e-9 * (np.abs(bounds) + reach) + 1
        return np.where(np.isnan(bounds), np.inf, bounds).tolist()


def products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    top = np.abs(points).max(initial=0) * np.abs(query).max(initial=0) * max(points.shape[1], 1)
    if top < 2**53:
        return (points @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in points]
    return np.array([min(max(x, LIMIT[0]), LIMIT[1]) for x in exact], dtype=np.int64)


def search(
    ids: np.ndarray, points: np.ndarray, queries: list[tuple[int, np.ndarray, int]], k: int
) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best rows per query that are not below its shared floor."""
    tree = Tree(points)
    found = []
    for query, vector, floor in queries:
        length = np.sqrt((vector**2).sum())
        best: list[tuple[int, int]] = []
        # The highest bound first; what stays in the queue when it falls below the floor is cut.
        queue = [(-tree.bounds([0], vector, length)[0], 0)]
        while queue and -queue[0][0] >= floor:
            node = heapq.heappop(queue)[1]
            if inner := tree.children[node]:
                for bound, child in zip(tree.bounds(inner, vector, length), inner):
                    if bound >= floor:
                        heapq.heappush(queue, (-bound, child))
                continue
            rows = tree.rows[node]
            scores = products(points[rows], vector)
            keep = (scores >= floor) & (ids[rows] != query)
            if keep.any():
                best += zip((-scores[keep]).tolist(), ids[rows][keep].tolist())
                best = sorted(best)[:k]
                if len(best) == k:
                    floor = max(floor, -best[-1][0])
        found += [(query, vec, -score) for score, vec in best]
    return found


def searcher(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def one(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if shard.empty or block.empty:
            return pd.DataFrame([], columns=columns)
        # A fixed order makes reruns of a lost task equal.
        shard = shard.sort_values("vec_id", kind="stable")
        points = np.array(shard["v"].tolist(), dtype=float).reshape(len(shard), -1)
        queries = [
            (int(q), np.array(v, dtype=float), int(f)) for q, v, f in zip(block["query_id"], block["v"], block["floor"])
        ]
        return pd.DataFrame(search(shard["vec_id"].to_numpy(), points, queries, k), columns=columns)

    return one


def top(df: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim) with whole-number components, without vectors that take no part."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), wide.alias("_x"))
        .where(F.col("_x").isNotNull() & F.col("vec_id").isNotNull() & ~bad)
        .select("vec_id", F.transform("_x", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.size("_x").alias("dim"))
    )


def exact_top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k best partners of every vector whose id is divisible by ``every``."""
    points = settle(whole_vectors(vectors))
    asked = settle(points.where(F.col("vec_id") % every == 0).distinct())
    shards = max(1, -(-points.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", "dim", "block")
    keys = ["dim", "shard", "block"]

    def wave(first: int, last: int, queries: DataFrame) -> DataFrame:
        held = dealt.where(F.col("shard").between(first, last)).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )
        sent = queries.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last))))
        return held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(searcher(k), FOUND)

    floor = F.lit(LIMIT[0])
    found = settle(wave(0, 0, asked.withColumn("floor", floor)))
    if shards > 1:
        reached = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth"))
        shared = asked.join(reached, "query_id", "left").withColumn(
            "floor", F.when(F.col("_n") == k, F.col("_kth")).otherwise(floor)
        ).drop("_n", "_kth")
        found = found.unionByName(wave(1, shards - 1, shared))
    return top(found, k).select("query_id", "rank", "vec_id", "score")
