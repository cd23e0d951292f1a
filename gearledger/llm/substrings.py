"""Suffix-array dedup: removing repeated byte strings, exactly, over all documents.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller
doc_id, or earlier in the same document. Every such string has one anchor, the smallest of the
hashed ``ANCHOR``-byte strings in it, and equal strings have equal anchors. Consecutive strings
with one anchor form a run, about one run per 37 bytes. Runs whose anchor occurs once end
there. Runs with the same bytes are one class, of which all but the first go. Classes that
share an anchor but differ are compared byte by byte: their bytes are put together in shards,
and on a shard's Burrows-Wheeler transform intervals are extended backwards, breadth first,
which yields the common prefixes of neighbouring suffixes by increasing length. It stops at
``LENGTH``: what has no boundary by then is a repeat.

Scale: a shard holds about ``SHARD_BYTES``. An anchor with more than ``ANCHOR_CLASSES``
different runs is not put into one shard; its strings are grouped by their hashes instead,
combined before the shuffle, which gives the same answer. Texts are moved twice, to fetch the
bytes of classes in question and to cut the final texts; everything else is narrow.

Defined results: null is the empty text; texts under ``LENGTH`` bytes lose nothing; strings
are judged on the input; rows that repeat a doc_id and its text are one document and keep the
same bytes; other texts under that doc_id are ordered by their hash; null doc_ids come last;
further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, text_mark
from .neardup import scramble

LENGTH, ANCHOR = 100, 28
SHARD_BYTES = 1 << 21
ANCHOR_CLASSES = 10_000
# Bytes of a batch that are worked on at once.
PIECE = 1 << 18
LAST = 2**63 - 1

MIX = np.random.default_rng(11)
VALUE = MIX.integers(0, 2**63, 256, dtype=np.uint64)
FACTOR = int(MIX.integers(0, 2**62)) * 2 + 1
POWERS = np.cumprod(np.full(PIECE + 2 * LENGTH, FACTOR, np.uint64))
INVERSE = np.cumprod(np.full(PIECE + 2 * LENGTH, pow(FACTOR, -1, 2**64), np.uint64))

RUNS = "d long, h long, anchor long, sid long, pos int, cnt int"
CUT = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),
    T.StructField("kept", T.BinaryType()),
])


def string_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end) from prefix sums."""
    return scramble((sums[end] - sums[start]) * INVERSE[start])


def runs_of(data: np.ndarray, owner_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, start and length of the runs of a piece of joined documents.

    ``owner_end`` is, for each byte, where its document ends in the piece.
    """
    n = len(data) - LENGTH + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[data] * POWERS[: len(data)])])
    at = np.arange(len(data) - ANCHOR + 1)
    hashes = string_hash(sums, at, at + ANCHOR)
    # The place in the low bits: the leftmost of equal hashes is the smallest.
    low = np.uint64((1 << 20) - 1)
    least = (hashes & ~low) | at.astype(np.uint64)
    width, window = 1, LENGTH - ANCHOR + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: n], least[window - width : window - width + n])
    anchor = (least[:n] & low).astype(np.int64)
    start = np.arange(n)
    whole = start + LENGTH <= owner_end[:n]
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    heads = np.flatnonzero(fresh & whole)
    # A run ends at the next head or at the first string that is not whole.
    breaks = np.append(np.flatnonzero(fresh | ~whole), n)
    ends = breaks[np.searchsorted(breaks, heads, side="right")]
    content = string_hash(sums, heads, ends - 1 + LENGTH)
    return hashes[anchor[heads]], content, heads, ends - heads


def anchored_runs(docs: DataFrame) -> DataFrame:
    """(d, h, anchor, sid, pos, cnt): the runs of all documents."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["data"].map(len).to_numpy(np.int64)
            batch, sizes = batch[sizes >= LENGTH], sizes[sizes >= LENGTH]
            if not len(batch):
                continue
            data = np.frombuffer(b"".join(batch["data"]), np.uint8)
            ends = np.cumsum(sizes)
            d, h = batch["d"].to_numpy(), batch["h"].to_numpy()
            for at in range(0, len(data) - LENGTH + 1, PIECE):
                piece = data[at : at + PIECE + LENGTH - 1]
                owner = np.searchsorted(ends, np.arange(at, at + len(piece)), side="right")
                anchor, sid, pos, cnt = runs_of(piece, ends[owner] - at)
                own = owner[pos]
                yield pd.DataFrame({
                    "d": d[own], "h": h[own], "anchor": anchor.view(np.int64), "sid": sid.view(np.int64),
                    "pos": (pos + at - (ends[own] - sizes[own])).astype(np.int32), "cnt": cnt.astype(np.int32),
                })

    return docs.mapInPandas(find, RUNS)


def rotations(symbols: np.ndarray) -> np.ndarray:
    """Order of the cyclic suffixes of a text by at least their first ``LENGTH`` symbols."""
    n = len(symbols)
    key, width = np.zeros(n, np.uint64), 0
    wrapped = np.concatenate([symbols, symbols[np.arange(7) % n]]).astype(np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | wrapped[k : k + n]
    width = 7
    while True:
        order = np.argsort(key)
        if width >= LENGTH:
            return order
        sorted_key = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])).astype(np.uint64)
        key = (rank << np.uint64(32)) | np.roll(rank, -width)
        width *= 2


def repeat_classes(symbols: np.ndarray) -> np.ndarray:
    """For each place of a text, the number of its class of equal ``LENGTH``-symbol strings.

    ``symbols`` ends with a separator. Neighbouring suffixes get their common prefix from the
    Burrows-Wheeler transform: the interval of a string w, extended by each symbol x that
    stands before it, is the interval of xw; when its right end is met for the first time,
    the common prefix there is |w|.
    """
    n = len(symbols)
    order = rotations(symbols)
    before = symbols[order - 1].astype(np.uint16)
    # last_first[i]: where the suffix that begins one symbol earlier stands.
    last_first = np.empty(n, np.int64)
    last_first[np.argsort(before, kind="stable")] = np.arange(n)
    bounded = np.zeros(n + 1, bool)
    bounded[[0, n]] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(LENGTH):
        if not len(left):
            break
        sizes = right - left
        alone = sizes == 1
        new_left, new_right = [last_first[left[alone]]], [last_first[left[alone]] + 1]
        left, sizes = left[~alone], sizes[~alone]
        if len(left):
            # All places of all intervals, then the first place and the count per (interval, symbol).
            interval = np.repeat(np.arange(len(left)), sizes)
            place = np.arange(len(interval)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + left[interval]
            key = interval * 512 + before[place].astype(np.int64)
            by_key = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], key[by_key][1:] != key[by_key][:-1]]))
            count = np.diff(np.append(heads, len(key)))
            begin = last_first[place[by_key[heads]]]
            new_left.append(begin)
            new_right.append(begin + count)
        left, right = np.concatenate(new_left), np.concatenate(new_right)
        fresh = ~bounded[right]
        left, right = left[fresh], right[fresh]
        # Several intervals never end at one place: they are disjoint or nested in one another's level.
        bounded[right] = True
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(bounded[:n])
    return classes


def repeated_in_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """Gram starts of the shard's runs that also start earlier, as ranges (d, h, pos, cnt)."""
    shard = shard.sort_values(["d", "h", "pos"], kind="stable")
    sizes = shard["data"].map(len).to_numpy(np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.frombuffer(b"\0".join(shard["data"]) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[starts + sizes] = 0
    classes = repeat_classes(symbols)
    cnt = shard["cnt"].to_numpy(np.int64)
    run = np.repeat(np.arange(len(cnt)), cnt)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
    own = classes[starts[run] + offset]
    pos = shard["pos"].to_numpy(np.int64)[run] + offset
    document = shard.groupby(["d", "h"], sort=True).ngroup().to_numpy()[run]
    order = np.lexsort((pos, document, own))
    later = np.zeros(len(run), bool)
    a, b = order[1:], order[:-1]
    first_of = np.maximum.accumulate(np.where(np.concatenate([[True], own[a] != own[b]]), np.arange(len(order)), 0))
    first = order[first_of]
    later[order] = (document[first] != document[order]) | (pos[first] != pos[order])
    flagged = np.flatnonzero(later)
    if not len(flagged):
        return pd.DataFrame([], columns=["d", "h", "pos", "cnt"])
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(flagged) != 1) | (np.diff(run[flagged]) != 0)]))
    lengths = np.diff(np.append(heads, len(flagged)))
    at = flagged[heads]
    return pd.DataFrame({
        "d": shard["d"].to_numpy()[run[at]], "h": shard["h"].to_numpy()[run[at]],
        "pos": pos[at].astype(np.int32), "cnt": lengths.astype(np.int32),
    })


def strings_of(runs: DataFrame) -> DataFrame:
    """Every string of the runs by itself: (low, high) hash, document and place."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (d, h, pos + k, *np.frombuffer(hashlib.blake2b(data[k : k + LENGTH], digest_size=16).digest(), np.int64).tolist())
                for d, h, pos, cnt, data in zip(batch["d"], batch["h"], batch["pos"], batch["cnt"], batch["data"])
                for k in range(cnt)
            ]
            yield pd.DataFrame(rows, columns=["d", "h", "pos", "low", "high"])

    return runs.mapInPandas(spell, "d long, h long, pos int, low long, high long")


def fetch_bytes(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``data``, the bytes of each class's first run."""
    wanted = classes.groupBy("d", "h").agg(F.collect_list(F.struct("anchor", "pos", "cnt", "hot")).alias("runs"))
    held = texts.join(wanted, ["d", "h"]).dropDuplicates(["d", "h"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (d, h, r["anchor"], r["pos"], r["cnt"], r["hot"], data[r["pos"] : r["pos"] + r["cnt"] - 1 + LENGTH])
                for d, h, data, runs in zip(batch["d"], batch["h"], batch["data"], batch["runs"])
                for r in runs
            ]
            yield pd.DataFrame(rows, columns=["d", "h", "anchor", "pos", "cnt", "hot", "data"])

    return held.mapInPandas(cut, "d long, h long, anchor long, pos int, cnt int, hot boolean, data binary")


def repeats(docs: DataFrame, anchor_classes: int = ANCHOR_CLASSES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(d, h, pos, cnt): starts of strings that also start earlier, as ranges per document."""
    runs = anchored_runs(docs)
    # Settled, so that the join may split a popular anchor: below an aggregate it could not.
    common = settle(runs.groupBy("anchor").count().where("count > 1").select("anchor"))
    runs = settle(runs.join(common, "anchor"))
    first = F.min(F.struct("d", "h", "pos", "cnt")).alias("first")
    classes = settle(runs.groupBy("anchor", "sid").agg(first, F.count(F.lit(1)).alias("n")))
    many = classes.where("n > 1").select(F.col("anchor").alias("_a"), F.col("sid").alias("_s"), "first")
    same = (F.col("anchor") == F.col("_a")) & (F.col("sid") == F.col("_s"))
    copies = runs.join(many, same).where(F.struct("d", "h", "pos") != F.struct("first.d", "first.h", "first.pos"))
    found = copies.select("d", "h", "pos", "cnt")
    differing = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    differing = settle(differing.select("anchor", (F.col("_n") > anchor_classes).alias("hot")))
    # Strings of one run differ: the anchor stands elsewhere in each.
    open_classes = classes.join(differing, "anchor").select("anchor", "first.*", "hot")
    fetched = settle(fetch_bytes(open_classes, docs))
    size = fetched.where("NOT hot").agg(F.sum(F.length("data"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    compared = (
        fetched.where("NOT hot").select("d", "h", "pos", "cnt", "data", shard)
        .groupBy("shard").applyInPandas(repeated_in_shard, "d long, h long, pos int, cnt int")
    )
    spelled = strings_of(fetched.where("hot"))
    leader = spelled.groupBy("low", "high").agg(F.min(F.struct("d", "h", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = spelled.join(settle(leader.where("n > 1")), ["low", "high"]).where(F.struct("d", "h", "pos") != F.col("first"))
    return found.unionByName(compared).unionByName(later.select("d", "h", "pos", F.lit(1).alias("cnt")))


@F.pandas_udf(CUT)
def cut_out(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    """Size, removed spans (flat starts and ends) and remaining bytes."""
    rows = []
    for data, flat in zip(texts, ranges):
        spans: list[int] = []
        if flat is not None and len(flat):
            pairs = np.asarray(flat, np.int64).reshape(-1, 2)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            reach = np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] - 1 + LENGTH)
            heads = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
            ends = reach[np.append(heads[1:], len(pairs)) - 1]
            spans = np.column_stack([pairs[heads, 0], ends]).ravel().tolist()
        edges = [0, *spans, len(data)]
        rows.append((len(data), spans, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))))
    return pd.DataFrame(rows, columns=["n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per document: removed spans and the remaining bytes."""
    rows = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(LAST)).alias("d"),
        text_mark().alias("h"),
        F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("data"),
    )
    found = settle(repeats(rows.drop("doc_id")))
    ranges = found.groupBy("d", "h").agg(F.collect_set(F.struct("pos", "cnt")).alias("_r"))
    flat = F.flatten(F.transform("_r", lambda r: F.array(r["pos"], r["cnt"])))
    joined = rows.join(ranges.select("d", "h", flat.alias("ranges")), ["d", "h"], "left")
    return joined.select("doc_id", cut_out("data", "ranges").alias("_c")).select("doc_id", "_c.*")


def substring_report(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the digest of what remains."""
    spans = F.col("spans")
    removed = F.col("n_bytes") - F.length("kept")
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_bytes",
        removed.cast("bigint").alias("n_removed"),
        (F.size(spans) / 2).cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
