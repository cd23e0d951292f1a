"""Toxicity: class-conditional Kneser-Ney models of words and word pairs.

Two models, toxic and ordinary, give each word its probability after the word before it. A word
alone has the class's continuation count (the number of different words that it follows), and
backs off to the continuation counts of both classes together. A pair has the class's count, and
backs off to the pair counts of both classes together, tilted by what the class makes of the
word alone: an expression that is rare in a class is smoothed by what the classes share, and
one that neither class knows well tells them apart no further than its parts do. Counts are of
documents, so a word repeated through one document is no evidence. The discounts of counts 1, 2
and more are ``DISCOUNTS``, with ``STRENGTH`` further counts given to the backoff.

A document's two log-likelihoods are compared expression by expression: the log ratio of a word
by itself, and that of the word after its neighbour beyond it; words that neither class has seen
have none. Ratios within ``MARGIN`` nats are what two samples of one language differ by, and
count as none. The sum over all words, divided by the number of words, becomes a probability through a logistic
curve fitted on a fold that the models have not seen.

Scale: pairs are counted per document where the text lies and summed by pair before and after
the shuffle. The tables of counts and of weights stay distributed and grow with the corpus; the
driver holds one row of totals, the cells of the logistic fit and two filters of 2^``BITS``
bits. The filters only save traffic: documents without a label, and expressions without a
weight, stay where they are but for a share that falls with the filter's size, and the exact
join follows. Documents with the same expressions, copies above all, meet the weights once.

Defined results: null and blank texts have no words and get the score of a text without any
evidence; labels other than 0 and 1 and labels of unknown documents are ignored; a document
labelled both ways counts for both; rows that repeat a doc_id are documents of their own; with
one class or no label at all no expression has a weight, and every score is that class's 0 or 1,
or 0.5; further columns play no part. 64-bit hashes stand for words and pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, whole_text
from .neardup import scramble

FOLDS = 5
# Remainder 0 is held out, 1 fits the logistic curve, the others give the counts.
CURVE_FOLD = 1
THRESHOLD = 0.5
DISCOUNTS = (1.0, 1.5, 2.0)
SHARED_DISCOUNT = 0.75
STRENGTH = 50.0
MARGIN = 2.0
# Words that every text is taken to have besides its own, so that one word is no proof.
EXTRA_WORDS = 10
BITS = 24
CELLS, STEEP, WIDEST = 64, 50.0, 8.0

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
START = np.uint64(xxhash.xxh3_64_intdigest(b""))
ODD = np.random.default_rng(12).integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

PAIRS = T.StructType([
    T.StructField("words", T.ArrayType(T.LongType())),
    T.StructField("heads", T.ArrayType(T.IntegerType())),
    T.StructField("tails", T.ArrayType(T.IntegerType())),
])
FOUND = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("counts", T.ArrayType(T.LongType())),
])


def word_hashes(text: str) -> np.ndarray:
    """The text's words in order, as 64-bit hashes."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def before(words: np.ndarray) -> np.ndarray:
    """Each word's neighbour to the left."""
    return np.concatenate([[START], words[:-1]]) if len(words) else words


def word_key(word: np.ndarray) -> np.ndarray:
    return scramble(word * ODD[0])


def head_key(head: np.ndarray) -> np.ndarray:
    return scramble(head * ODD[1])


def pair_key(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    return scramble(head * ODD[2] + word * ODD[3])


@F.pandas_udf(PAIRS)
def pairs_of(texts: pd.Series) -> pd.DataFrame:
    """Distinct pairs of neighbours of each text: its distinct words, and places among them."""
    rows = []
    for text in texts:
        words = word_hashes(text)
        table, places = np.unique(np.concatenate([before(words), words]), return_inverse=True)
        heads, tails = places[: len(words)], places[len(words) :]
        pairs = np.unique(heads * len(table) + tails)
        rows.append((table.view(np.int64), (pairs // max(len(table), 1)).astype(np.int32), (pairs % max(len(table), 1)).astype(np.int32)))
    return pd.DataFrame(rows, columns=["words", "heads", "tails"])


def key_of(kind: Callable[..., np.ndarray]) -> Callable[..., Column]:
    """One of the keys above as a Column function of long columns."""

    @F.pandas_udf(T.LongType())
    def one(a: pd.Series) -> pd.Series:
        return pd.Series(kind(a.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    @F.pandas_udf(T.LongType())
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(kind(a.to_numpy(np.int64).view(np.uint64), b.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return two if kind is pair_key else one


def filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over a column ``key`` of 64-bit hashes, two bits a key."""
    mask = (1 << BITS) - 1
    places = F.explode(F.array(F.col("key").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(mask))))
    words = (
        keys.select(places.alias("place"))
        .groupBy(F.shiftright("place", 6).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .toPandas()  # at most 2^(BITS - 6) rows
    )
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold; it never denies one that it does."""
    mask = np.uint64((1 << BITS) - 1)
    inside = np.ones(len(keys), bool)
    for place in (keys & mask, (keys >> np.uint64(32)) & mask):
        inside &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return inside


def maybe(bits: np.ndarray) -> Callable[[Column], Column]:
    """The filter as a Column function of long hashes."""

    @F.pandas_udf(T.BooleanType())
    def held(keys: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits, keys.to_numpy(np.int64).view(np.uint64)))

    return held


def finder(bits: np.ndarray) -> Callable[[Column], Column]:
    """A Column function: number of words, and the keys that may have a weight, with their counts."""

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = word_hashes(text)
            heads = before(words)
            keys = np.concatenate([word_key(words), head_key(heads), pair_key(heads, words)])
            keys, counts = np.unique(keys[may_hold(bits, keys)], return_counts=True)
            rows.append((len(words), keys.view(np.int64), counts))
        return pd.DataFrame(rows, columns=["n", "keys", "counts"])

    return found


def fold() -> Column:
    """The remainder that decides what a document's label may be used for; null is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(0))


def marks(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the usable labels."""
    return labels.where(F.col("toxic").isin(0, 1) & (fold() != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()


def pair_counts(docs: DataFrame, taught: DataFrame) -> DataFrame:
    """(h, w, c0, c1): in how many documents of each class word w follows word h; written once."""
    known = maybe(filter_of(taught.select(F.xxhash64("doc_id").alias("key"))))
    # Texts move in their own letters, which pack better than the hashes of their words.
    lent = docs.where(F.col("doc_id").isNotNull()).where(known(F.xxhash64("doc_id"))).select("doc_id", whole_text().alias("text"))
    placed = lent.join(taught, "doc_id").select("toxic", pairs_of("text").alias("_p")).select(
        "toxic",
        F.explode(
            F.transform(
                F.arrays_zip("_p.heads", "_p.tails"),
                lambda x: F.struct(F.get("_p.words", x["heads"]).alias("h"), F.get("_p.words", x["tails"]).alias("w")),
            )
        ).alias("_x"),
    )
    return settle(
        placed.groupBy("_x.h", "_x.w").agg(F.sum(1 - F.col("toxic")).cast("int").alias("c0"), F.sum("toxic").cast("int").alias("c1"))
        .sortWithinPartitions("h")
    )


def kept(count: Column) -> Column:
    """A count less its discount."""
    lost = F.when(count == 1, DISCOUNTS[0]).when(count == 2, DISCOUNTS[1]).otherwise(DISCOUNTS[2])
    return F.greatest(count - lost, F.lit(0.0))


def beyond(ratio: Column) -> Column:
    """What a log ratio says beyond the margin."""
    return F.signum(ratio) * F.greatest(F.abs(ratio) - MARGIN, F.lit(0.0))


def weights_of(pairs: DataFrame) -> DataFrame:
    """(key, weight) of every expression with evidence, from settled pair counts; written once."""
    words = settle(
        pairs.groupBy("w").agg(F.count_if(F.col("c0") > 0).alias("k0"), F.count_if(F.col("c1") > 0).alias("k1"), F.count(F.lit(1)).alias("k"))
    )
    heads = settle(
        pairs.groupBy("h").agg(
            *[F.sum(f"c{y}").alias(f"t{y}") for y in (0, 1)],
            *[F.sum(F.col(f"c{y}") - kept(F.col(f"c{y}"))).alias(f"l{y}") for y in (0, 1)],
            F.count(F.lit(1)).alias("kinds"),
        )
    )
    total = words.agg(
        F.sum("k").alias("k"), F.count(F.lit(1)).alias("v"),
        *[F.sum(f"k{y}").alias(f"k{y}") for y in (0, 1)],
        *[F.sum(F.col(f"k{y}") - kept(F.col(f"k{y}"))).alias(f"l{y}") for y in (0, 1)],
    ).first()
    v = total["v"]
    shared = (F.greatest(F.col("k") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * v / (v + 1)) / float(total["k"] or 1)
    spare = [STRENGTH + (total[f"l{y}"] or 0.0) for y in (0, 1)]
    size = [STRENGTH + (total[f"k{y}"] or 0) for y in (0, 1)]
    alone = [(kept(F.col(f"k{y}")) + spare[y] * F.col("shared")) / size[y] for y in (0, 1)]
    judged = words.withColumn("shared", shared).select("w", "shared", alone[0].alias("p0"), alone[1].alias("p1")).withColumn("u", F.log(F.col("p1") / F.col("p0")))
    open_mass = [(F.col(f"l{y}") + STRENGTH) / (F.col(f"t{y}") + STRENGTH) for y in (0, 1)]
    backed = heads.withColumn("g", F.log(open_mass[1] / open_mass[0]))
    # A pair that keeps nothing after the discounts is its backoff in both classes: beyond its word
    # it says what its head says, and its weight is exactly 0. With other discounts others are left.
    rich = pairs.where((kept(F.col("c0")) > 0) | (kept(F.col("c1")) > 0)).join(judged, "w").join(backed, "h")
    both = F.greatest(F.col("c0") + F.col("c1") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * F.col("kinds") * F.col("shared")
    rich = rich.withColumn("tied", both / (F.col("t0") + F.col("t1")) / F.col("shared"))
    together = [
        (kept(F.col(f"c{y}")) + (F.col(f"l{y}") + STRENGTH) * F.col("tied") * F.col(f"p{y}")) / (F.col(f"t{y}") + STRENGTH) for y in (0, 1)
    ]
    of_pair = beyond(F.log(together[1] / together[0]) - F.col("u")) - beyond(F.col("g"))
    tables = [
        judged.select(beyond(F.col("u")).alias("weight"), "w").where("weight <> 0").select(key_of(word_key)("w").alias("key"), "weight"),
        backed.select(beyond(F.col("g")).alias("weight"), "h").where("weight <> 0").select(key_of(head_key)("h").alias("key"), "weight"),
        rich.select(of_pair.alias("weight"), "h", "w").where("weight <> 0").select(key_of(pair_key)("h", "w").alias("key"), "weight"),
    ]
    return settle(reduce(DataFrame.unionByName, tables))


def expressions(told: DataFrame) -> DataFrame:
    """(one, two, key, times) of every distinct set of expressions: texts that share theirs, such as
    copies, are one here. Two 64-bit hashes name a set."""
    sets = told.where(F.size("keys") > 0).select("one", "two", "keys", "counts").dropDuplicates(["one", "two"])
    return sets.select("one", "two", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("counts").alias("times"))))


def evidence(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, x) of every document: what its words say per word, on a bent scale; written once."""
    found = finder(filter_of(weights))
    names = [F.xxhash64("_f.keys", "_f.counts").alias("one"), F.xxhash64(F.lit(1), "_f.counts", "_f.keys").alias("two")]
    told = settle(docs.select("doc_id", found(whole_text()).alias("_f")).select("doc_id", "_f.*", *names))
    # Written once, so that the join below may split a set that very many documents share.
    sums = settle(expressions(told).join(weights, "key").groupBy("one", "two").agg(F.sum(F.col("times") * F.col("weight")).alias("said")))
    plain = ["doc_id", "n", "one", "two"]
    # Most texts have no expression at all: they share one set and stay out of the join.
    spoken = told.where(F.size("keys") > 0).select(*plain).join(sums, ["one", "two"], "left").select("doc_id", "n", "said")
    silent = told.where(F.size("keys") == 0).select("doc_id", "n", F.lit(None).cast("double").alias("said"))
    per_word = F.coalesce("said", F.lit(0.0)) / (F.col("n") + EXTRA_WORDS)
    return settle(spoken.unionByName(silent).select("doc_id", F.asinh(per_word * STEEP).alias("x")))


def logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and intercept by Newton's method from counts of both classes at each x."""
    rows = np.stack([x, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta @ rows, -30, 30)))
        n = good + bad
        gradient = rows @ (bad - n * p) - ridge * beta
        curve = (rows * (n * p * (1 - p))) @ rows.T + ridge * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether its label was held out, its score and the predicted label."""
    taught = settle(marks(labels))
    pairs = pair_counts(docs.select("doc_id", "text"), taught.where(fold() != CURVE_FOLD))
    classes = pairs.agg(F.max("c0").alias("c0"), F.max("c1").alias("c1")).first()
    seen = [bool(classes["c0"]), bool(classes["c1"])]
    if not all(seen):
        constant = 1.0 if seen[1] else 0.0 if seen[0] else 0.5
        scored = docs.select("doc_id", F.lit(constant).alias("score"))
    else:
        told = evidence(docs.select("doc_id", "text"), weights_of(pairs))
        cell = F.round(F.least(F.greatest(F.col("x"), F.lit(-WIDEST)), F.lit(WIDEST)) * CELLS).cast("int")
        cells = (
            told.select("doc_id", cell.alias("cell")).join(taught.where(fold() == CURVE_FOLD), "doc_id")
            .groupBy("cell").agg(F.sum(1 - F.col("toxic")).alias("good"), F.sum("toxic").alias("bad"))
            .toPandas()  # at most 2 * WIDEST * CELLS + 1 rows
        )
        good, bad = (cells[c].to_numpy(float) for c in ("good", "bad"))
        if not (good.sum() and bad.sum()):
            # Nothing to fit on: even odds where the evidence is one expression in twenty words.
            slope, shift = 4.0, -4.0
        else:
            slope, shift = logistic(cells["cell"].to_numpy(float) / CELLS, good, bad)
        scored = told.select("doc_id", (1 / (1 + F.exp(-(F.col("x") * slope + shift)))).alias("score"))
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
