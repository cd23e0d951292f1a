"""MinHash near-dedup with SetSketch registers.

A document is its set of five-word shingles. Its sketch keeps, per register, the least
exponential hash value on a scale of powers of ``BASE``, truncated to 16 bits; registers of a
union are the larger ones of both, and equal registers are about as frequent as common
shingles. ``ROWS`` registers make a band; documents that share a band are candidates. Their
similarity is estimated from all registers and both set sizes by maximum likelihood, and what
may reach the threshold is confirmed on the full sets.

Documents with equal sets are one class; links are sought between classes only. In a shared
band every class is compared with a pivot, a different one each round, until the band lies in
one component. Rounds of pivots end when they hardly add links. A class of which more than a
quarter of the shingles stand in no other open class can have no link, and leaves. What is still
open is compared in blocks of at most ``BLOCK`` classes and ``BLOCK_BYTES`` of sets, so no band,
however large, meets in one task. A block holds the full sets: its pairs are confirmed where they
are found, the most similar first and only while they are apart, and no more than a forest of
links leaves it. No table of pairs is made.

Scale: texts are read for the sketches and once more for the sets of candidates. Band keys
move once to be counted and once to be kept; single ones end there. Links and components stay
distributed tables.

Recall: a pair at the threshold shares no band with probability (1 - 0.75^4)^64 = 3e-11.

Defined results: null and blank texts have an empty set and are linked with nothing, each its
own component; texts of fewer than five words are one shingle; rows that repeat a doc_id are
separate documents of that id; a null doc_id is never the least one; further columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, unwrap, whole_text, wrap
from .components import components

SHINGLE = 5
THRESHOLD = 75
REGISTERS, ROWS = 256, 4
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
# An estimate this far below the threshold is over five standard deviations away, and so is a
# share of equal registers.
FLOOR, NEAR = 0.6, 0.58
# Pivots go on while a round adds this part of all links; blocks find what is left.
PAYS_OFF, PIVOT_ROUNDS = 0.1, 2
BLOCK, BLOCK_BYTES = 512, 16 << 20
PEELS = 2
PIECE = 4096

MIX = np.random.default_rng(5)
STEP = MIX.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = MIX.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("registers", T.BinaryType()),
])


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    if not width:
        return h
    total = np.full(len(h) - width + 1, (int(STEP[SHINGLE]) * width) % 2**64, np.uint64)
    for k in range(width):
        total += h[k : len(h) - width + 1 + k] * STEP[k]
    return np.unique(scramble(total))


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: truncated powers of the least exponential values."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PIECE):
        np.minimum(least, (ODD[:, None] * hashes[at : at + PIECE]).min(axis=1), out=least)
    uniform = ((least >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    level = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    return np.clip(level, 0, TOP).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches (rows) by maximum likelihood, set sizes known."""
    above, below = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    u = na / (na + nb)
    v = 1 - u

    def odds(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = odds(u - v * j), odds(v - u * j)
        return above * np.log(p) + below * np.log(q) + (REGISTERS - above - below) * np.log(np.clip(1 - p - q, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one peak
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


@F.pandas_udf(SKETCH)
def sketch_of(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = shingles(text)
        if len(found):
            rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), registers(found).tobytes()))
        else:
            rows.append((0, None, None))
    return pd.DataFrame(rows, columns=["n", "key", "registers"])


@F.pandas_udf(T.BinaryType())
def set_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: shingles(text).tobytes())


def matrix(registers_of: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(registers_of), "<u2").reshape(-1, REGISTERS)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    return pd.Series(estimate(matrix(a), matrix(b), na.to_numpy(float), nb.to_numpy(float)))


@F.pandas_udf(T.LongType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two full sets."""
    sets = zip(a, b)
    return pd.Series([
        len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in sets
    ], dtype="int64")


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, key, registers) of every document, written once."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch_of(whole_text()).alias("_s"))
    return settle(own.select("doc_id", "text_hash", "_s.*"))


def with_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with the columns of both ends."""
    for side in "ab":
        ends = table.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(ends, side)
    return pairs


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes and estimate leave the threshold in reach, with the estimate."""
    sized = with_sides(pairs, classes, "n", "registers")
    sized = sized.where(100 * F.least("n_a", "n_b") >= THRESHOLD * F.greatest("n_a", "n_b"))
    told = sized.withColumn("est", similarity("registers_a", "registers_b", "n_a", "n_b"))
    return told.where(F.col("est") >= FLOOR).select("a", "b", "n_a", "n_b", "est")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, counted on full sets."""
    both = with_sides(pairs.select("a", "b", "n_a", "n_b"), sets, "hashes").withColumn("_i", common("hashes_a", "hashes_b"))
    return both.where(100 * F.col("_i") >= THRESHOLD * (F.col("n_a") + F.col("n_b") - F.col("_i"))).select("a", "b")


def pairs_within(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of plausible pairs in one block of a band, or between two of them.

    A pair belongs to the first band that it shares, so it is made once.
    """
    slot = block["slot"].iloc[0]
    table, sizes = matrix(block["registers"]), block["n"].to_numpy(float)
    numbers: dict[bytes, int] = {}
    roots = np.array([numbers.setdefault(r, len(numbers)) for r in block["root"]])
    side = block["side"].to_numpy()
    left, right = [], []
    for i in np.flatnonzero(side != 1):
        rest = np.arange(i + 1, len(block)) if side[i] == 2 else np.flatnonzero(side == 1)
        rest = rest[(roots[rest] != roots[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= THRESHOLD * np.maximum(sizes[rest], sizes[i]))]
        if len(rest):
            equal = table[rest] == table[i]
            first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            rest = rest[(equal.mean(axis=1) >= NEAR) & (first == slot)]
            left.append(np.full(len(rest), i))
            right.append(rest)
    none = np.zeros(0, int)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest_of(block: pd.DataFrame) -> list[tuple[int, int]]:
    """Links between rows of a block that connect all its rows that links connect."""
    left, right = pairs_within(block)
    if not len(left):
        return []
    sizes, table = block["n"].to_numpy(np.int64), matrix(block["registers"])
    est = estimate(table[left], table[right], sizes[left].astype(float), sizes[right].astype(float))
    sets = [np.frombuffer(x, np.uint64) for x in block["hashes"]]
    heads: dict = {}

    def top(x: object) -> object:
        while x in heads:
            x = heads[x]
        return x

    roots, found = block["root"].tolist(), []
    for k in np.argsort(-est, kind="stable"):
        a, b = int(left[k]), int(right[k])
        if est[k] < FLOOR:
            break
        one, other = top(roots[a]), top(roots[b])
        if one == other:
            continue
        shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * shared >= THRESHOLD * (sizes[a] + sizes[b] - shared):
            heads[one] = other
            found.append((a, b))
    return found


def block_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) between components from rows sorted by (band, i, j)."""

    def judge(rows: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        keys = rows["key"].tolist()
        pairs = [(a + x, a + y) for a, b in zip(edges[:-1], edges[1:]) if b - a > 1 for x, y in forest_of(rows.iloc[a:b])]
        return pd.DataFrame([tuple(sorted((keys[x], keys[y]))) for x, y in pairs], columns=["a", "b"])

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        group = rows[["band", "i", "j"]].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
        # The last group may go on in the next batch.
        held = rows.iloc[edges[-1] :].reset_index(drop=True)
        if len(edges) > 1:
            yield judge(rows, edges)
    if held is not None:
        yield judge(held, np.array([0, len(held)]))


@F.pandas_udf(T.ArrayType(T.LongType()))
def listed(sets: pd.Series) -> pd.Series:
    return sets.map(lambda data: np.frombuffer(data, np.int64))


def supported(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """The classes (key) that may have a link: enough of their shingles stand in another one, too.

    What a link shares is three quarters of both sets. A shingle of a single class counts
    against it; no shingle is looked up again, so a popular one combines before the shuffle.
    """
    tokens = sets.join(keys, "key").select("key", F.explode(listed("hashes")).alias("token"))
    single = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1")
    lone = single.groupBy("key").agg(F.count(F.lit(1)).alias("lone"))
    held = sets.join(keys, "key").select("key", F.floor(F.octet_length("hashes") / 8).alias("n"))
    fit = 100 * (F.col("n") - F.coalesce("lone", F.lit(0))) >= THRESHOLD * F.col("n")
    return settle(held.join(lone, "key", "left").where(fit).select("key"))


def place(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members with the root of their component, themselves where they have none yet."""
    if roots is None:
        return members.withColumn("root", F.col("key"))
    known = roots.withColumnRenamed("node", "key")
    return members.join(known, "key", "left").withColumn("root", F.coalesce("root", "key"))


def open_bands(placed: DataFrame, turn: int) -> DataFrame:
    """Bands that lie in more than one component, with their size and this turn's pivot.

    First it is the class that meets the most others, as the origin of many copies does, then
    any one.
    """
    order = -F.col("meets") if turn == 0 else F.xxhash64(F.lit(turn), "key")
    mark = F.struct(order.alias("order"), F.col("key").alias("key"), F.col("root").alias("root"))
    return placed.groupBy("band").agg(
        F.min(mark).alias("pivot"), F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")
    ).where("low <> high").drop("low", "high")


def extend(links: DataFrame, roots: DataFrame | None, fresh: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """All links, their components, and how many links are new."""
    added = fresh.count()
    if not added:
        return links, roots, 0
    links = links.unionByName(fresh)
    return links, settle(components(links)), added


def link_classes(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, root) of every class that is linked with another one."""
    classes = settle(
        facts.where("key IS NOT NULL").groupBy("key").agg(
            F.first("n").alias("n"), F.first("registers").alias("registers"),
            F.min(F.struct("doc_id", "text_hash")).alias("at"),
        )
    )
    band = lambda i: F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS))
    bands = classes.select("key", F.posexplode(F.array(*[band(i) for i in range(BANDS)])).alias("slot", "band"))
    shared = settle(bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = settle(bands.join(shared, "band"))
    meets = settle(members.groupBy("key").agg(F.sum("size").alias("meets")))
    members = settle(members.drop("size").join(meets, "key"))
    candidates = classes.join(members.select("key").distinct(), "key").select("key", "at.*")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = candidates.join(
        texts.withColumnRenamed("doc_id", "_id"),
        (F.col("_id").eqNullSafe(F.col("doc_id"))) & (texts["text_hash"] == candidates["text_hash"]),
    ).drop(texts["text_hash"], "_id")
    # Rows of equal keys are equal; the join has brought them together.
    one = rows.dropDuplicates(["doc_id", "text_hash", "key"])
    sets = settle(one.select("key", set_of(whole_text()).alias("hashes")))
    ends = members.select(F.col("key").alias("a"), F.col("key").alias("b"))
    links, roots, total = settle(ends.limit(0)), None, 0
    # Settled aggregates: a join below an aggregate could not split a popular band.
    for turn in range(PIVOT_ROUNDS):
        placed = settle(place(members, roots))
        pivots = settle(open_bands(placed, turn))
        pairs = placed.join(pivots, "band").where(F.col("root") != F.col("pivot.root")).select(
            F.col("key").alias("a"), F.col("pivot.key").alias("b")
        ).distinct()
        # One confirmation per class and round: its most similar pivot.
        near = plausible(pairs, classes).groupBy("a").agg(F.max(F.struct("est", "b", "n_a", "n_b")).alias("best"))
        links, roots, added = extend(links, roots, settle(confirmed(near.select("a", "best.*"), sets)))
        total += added
        if added <= PAYS_OFF * total:
            break
    placed = settle(place(members, roots))
    live = settle(placed.join(open_bands(placed, 0).select("band"), "band").select("key").distinct())
    for _ in range(PEELS):
        live = supported(live, sets)
    facts = classes.join(live, "key").select("key", "n", "registers").join(sets, "key")
    rows = settle(placed.join(live, "key", "left_semi"))
    still = open_bands(rows, 0).select("band")
    weights = settle(
        rows.join(still, "band").join(classes.select("key", "n"), "key").groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    )
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("n") * 8 / BLOCK_BYTES)).cast("int")
    sizes = settle(weights.select("band", parts.alias("parts")))
    dealt = rows.join(sizes, "band").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    sides = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(
            F.least(F.col("part"), p).alias("i"), F.greatest(F.col("part"), p).alias("j"),
            F.when(F.col("part") == p, 2).when(F.col("part") < p, 0).otherwise(1).alias("side"),
        ),
    )
    told = dealt.select("band", "slot", "key", "root", F.inline(sides)).join(facts, "key")
    near = told.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInPandas(block_links, "a binary, b binary")
    _, roots, _ = extend(links, roots, settle(near.distinct()))
    return roots if roots is not None else ends.limit(0).toDF("node", "root")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, group, component) per document; an empty set has no group."""
    facts = sketches(docs.select("doc_id", "text"))
    roots = link_classes(docs.select("doc_id", "text"), facts)
    least = facts.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"))
    placed = least.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = placed.groupBy("root").agg(F.min("first").alias("component"))
    known = settle(placed.select("key", "root").join(named, "root").select("key", F.col("root").alias("group"), "component"))
    return facts.select("doc_id", "text_hash", "n", "key").join(known, "key", "left").drop("key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: size of its set, its component's least doc_id and whether it is that one."""
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return grouped(docs).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group (least doc_id, then text hash) and all empty ones, same columns."""
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    chosen = grouped(docs).where("group IS NOT NULL").groupBy("group").agg(F.min(rank).alias("_first"))
    chosen = settle(chosen.select(F.col("_first.doc_id").alias("_id"), F.col("_first.text_hash").alias("_hash")))
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = wrap(docs, doc_id=F.col("doc_id"), text_hash=F.xxhash64("text"), blank=blank)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    # The join has brought equal rows together; repeated ones leave here.
    one = rows.where("NOT blank").join(chosen, same).dropDuplicates(["doc_id", "text_hash"])
    return unwrap(one, docs).unionByName(unwrap(rows.where("blank"), docs))
