"""Conversation prefix trie by fixed-length block hashing.

A conversation is its sequence of turns (role, text). The trie has one node per distinct
sequence of first turns. Conversations are cut into blocks of ``BLOCK`` turns and grouped by
successive block digests first: (digest of all turns before the block, digest of the block).
What one block holds is looked into once per distinct block, not once per conversation; and
only where several blocks follow the same prefix are their turns counted one by one. Inside a
block without siblings every turn has the block's own members.

A digest is the exclusive or, over the turns, of two 64-bit hashes of (position, SHA-256 of role
and text): 128 bits, and a running fold, so that a conversation of any length is scanned in
ranges (``numbering.range_scan``) and never meets in one task.

Sums over subtrees double their reach each round: after round j a node has the sums of all
nodes less than 2^j below it and knows its ancestor 2^j above. The rounds are the logarithm of
the depth, and each is a sum by ancestor, combined before the shuffle.

The list of members that end at a node is hashed as a stream: ranges of (node, id) write their
ids as pieces of text, and one pass over the pieces of a node feeds the hash. SHA-256 cannot be
split, so a node's pieces pass through one task, 64 K ids a row, never held together.

Defined results: a row without conv_id belongs to no conversation; null roles and texts are
empty; a null turn comes first; turns of equal number follow the digest of their role and text;
repeated rows are repeated turns; a table without conversations has no node, not even a root;
further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import range_scan
from .common import settle

BLOCK = 4
# A conversation borrows up to this many turns less one of the first conversation of its hundred.
BORROWED, HUNDRED = 6, 100
PIECE = 1 << 16
NODE = ["d1", "d2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, content, size): every turn's place from 0, digest and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.sha2(told, 256)).alias("content"), F.char_length(text).cast("bigint").alias("size"),
        F.lit(1).cast("bigint").alias("one"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("content").asc()]
    placed = range_scan(turns, ["conv_id"], order, {"at": "one"})
    return placed.select("conv_id", F.coalesce("at", F.lit(0)).cast("bigint").alias("at"), "content", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first one of their hundred.

    Returns (conv_id, length) of every conversation and (conv_id, length, at, content, size) of
    every turn.
    """
    heads = (
        turns.where((F.col("conv_id") % HUNDRED == 0) & (F.col("at") < BORROWED - 1))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "content", "size"))).alias("head"))
    )
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    plan = settle(
        whole.withColumn("skip", skip)
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED)
        .join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<at:bigint,content:binary,size:bigint>>")), F.lit(1), F.col("skip").cast("int")))
        .withColumn("taken", F.size("head").cast("bigint"))
        .select("conv_id", "skip", "taken", "head", (F.col("taken") + F.greatest(F.col("own") - F.col("skip"), F.lit(0))).alias("length"))
    )
    kept = turns.join(plan.drop("head"), "conv_id").where("at >= skip").select(
        "conv_id", "length", (F.col("at") - F.col("skip") + F.col("taken")).alias("at"), "content", "size"
    )
    return plan.select("conv_id", "length"), kept.unionByName(plan.select("conv_id", "length", F.inline("head")))


def blocks_of(turns: DataFrame, block: int) -> DataFrame:
    """Blocks of turns (at, h1, h2, size) with the digest (b1, b2) and that of all turns before (p1, p2)."""
    hashed = turns.select(
        "conv_id", "length", F.floor(F.col("at") / block).alias("number"), "at", "size",
        F.xxhash64("at", "content").alias("h1"), F.xxhash64(F.lit("second"), "at", "content").alias("h2"),
    )
    blocks = hashed.groupBy("conv_id", "length", "number").agg(
        F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"),
        F.sort_array(F.collect_list(F.struct("at", "h1", "h2", "size"))).alias("turns"),
    )
    chained = range_scan(blocks, ["conv_id"], ["number"], {"p1": "b1", "p2": "b2"}, F.bit_xor)
    return chained.withColumns({p: F.coalesce(p, F.lit(0).cast("bigint")) for p in ("p1", "p2")})


def prefixes(turns: str, p1: str, p2: str) -> Column:
    """The nodes inside a block: depth, digest, parent's digest, size of the last text."""

    def digest(count: Column, before: str, half: str) -> Column:
        return F.aggregate(F.slice(turns, F.lit(1), count), F.col(before), lambda x, t: x.bitwiseXOR(t[half]))

    def node(turn: Column, i: Column) -> Column:
        return F.struct(
            (turn["at"] + 1).alias("depth"),
            digest(i + 1, p1, "h1").alias("d1"), digest(i + 1, p2, "h2").alias("d2"),
            digest(i, p1, "h1").alias("u1"), digest(i, p2, "h2").alias("u2"),
            turn["size"].alias("size"),
        )

    return F.transform(turns, node)


def nodes_of(blocks: DataFrame) -> DataFrame:
    """(depth, d1, d2, u1, u2, size, n_convs, first) of every node but the root."""
    followed = ["number", "p1", "p2"]
    distinct = settle(
        blocks.groupBy(*followed, "b1", "b2").agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("first"), F.first("turns").alias("turns")
        )
    )
    forks = distinct.groupBy(*followed).agg(F.count(F.lit(1)).alias("branches")).where("branches > 1")
    told = distinct.join(forks, followed, "left").select(
        "branches", "n_convs", "first", F.inline(prefixes("turns", "p1", "p2"))
    )
    told = settle(told)
    facts = ["depth", "u1", "u2", "size"]
    refined = told.where("branches IS NOT NULL").groupBy(*NODE).agg(
        *[F.first(c).alias(c) for c in facts], F.sum("n_convs").alias("n_convs"), F.min("first").alias("first")
    )
    return told.where("branches IS NULL").select(*NODE, *facts, "n_convs", "first").unionByName(refined)


def subtree_sums(nodes: DataFrame, values: list[str], depth: int) -> DataFrame:
    """Every node's values summed over its subtree; (u1, u2) is its parent, ``depth`` the deepest."""
    state = nodes.select(*NODE, "u1", "u2", *values)
    reach = 1
    while reach <= depth:
        below = state.where("u1 IS NOT NULL").groupBy("u1", "u2").agg(*[F.sum(v).alias(f"_{v}") for v in values])
        above = state.select(F.col("d1").alias("u1"), F.col("d2").alias("u2"), F.col("u1").alias("w1"), F.col("u2").alias("w2"))
        summed = state.join(below.select(F.col("u1").alias("d1"), F.col("u2").alias("d2"), *[f"_{v}" for v in values]), NODE, "left")
        state = settle(
            summed.join(above, ["u1", "u2"], "left").select(
                *NODE, F.col("w1").alias("u1"), F.col("w2").alias("u2"),
                *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values],
            )
        )
        reach *= 2
    return state.select(*NODE, *values)


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of rows sorted by (node, id), written as comma-joined texts of up to ``PIECE`` ids a node."""
    held: list[tuple] = []

    def flush() -> pd.DataFrame:
        joined = [(a, b, int(ids[0]), ",".join(map(str, ids))) for a, b, ids in held]
        held.clear()
        return pd.DataFrame(joined, columns=["d1", "d2", "start", "ids"])

    waiting = 0
    for batch in batches:
        if not len(batch):
            continue
        d1, d2, ids = (batch[c].to_numpy(np.int64) for c in ("d1", "d2", "conv_id"))
        edges = np.flatnonzero(np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])))
        for a, b in zip(edges, np.append(edges[1:], len(batch))):
            if held and held[-1][:2] == (d1[a], d2[a]) and len(held[-1][2]) + b - a <= PIECE:
                held[-1][2].extend(ids[a:b].tolist())
            else:
                held.append((d1[a], d2[a], ids[a:b].tolist()))
        waiting += len(batch)
        if waiting >= PIECE:
            yield flush()
            waiting = 0
    if held:
        yield flush()


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One SHA-256 per node from pieces sorted by (node, start); only the running hash is held."""
    node, running = None, None
    for batch in batches:
        done = []
        for d1, d2, ids in zip(batch["d1"], batch["d2"], batch["ids"]):
            if node == (d1, d2):
                running.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, running.hexdigest()))
            node, running = (d1, d2), hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["d1", "d2", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, running.hexdigest())], columns=["d1", "d2", "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) from (d1, d2, conv_id) of every conversation's last node."""
    spread = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    written = spread.mapInPandas(pieces, "d1 long, d2 long, start long, ids string")
    streamed = written.repartition(*NODE).sortWithinPartitions(*NODE, "start")
    return streamed.mapInPandas(digests, "d1 long, d2 long, ends_sha256 string")


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie over (conv_id, length) and (conv_id, length, at, content, size).

    Every node: its digest, least member, depth, parent's least member, members, children,
    leaves and repeated code points below it, and the hash of the members that end there.
    """
    blocks = settle(blocks_of(turns, BLOCK))
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    root = conversations.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("first")).where("n_convs > 0").select(
        zero.alias("d1"), zero.alias("d2"), zero.alias("depth"), none.alias("u1"), none.alias("u2"), zero.alias("size"), "n_convs", "first"
    )
    nodes = settle(nodes_of(blocks).unionByName(root))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    children = nodes.where("u1 IS NOT NULL").groupBy(F.col("u1").alias("d1"), F.col("u2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("d1").alias("u1"), F.col("d2").alias("u2"), F.col("first").alias("parent_conv_id"))
    known = settle(
        nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
        .join(parents, ["u1", "u2"], "left")
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint"))
        .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size"))
    )
    sums = subtree_sums(known, ["n_leaves", "saved_tokens"], deepest)
    last = blocks.where(F.col("number") == F.floor((F.col("length") - 1) / BLOCK)).select(
        F.col("p1").bitwiseXOR(F.col("b1")).alias("d1"), F.col("p2").bitwiseXOR(F.col("b2")).alias("d2"), "conv_id"
    )
    turnless = conversations.where("length = 0").select(zero.alias("d1"), zero.alias("d2"), "conv_id")
    ends = ends_of(settle(last.unionByName(turnless)))
    return known.drop("n_leaves", "saved_tokens").join(sums, NODE).join(ends, NODE, "left")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    whole, turns = rebuilt(settle(turns_of(conversations)))
    return trie(whole, turns).select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
