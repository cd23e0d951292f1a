"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source asks for its weight's share of the budget, but may be read at most
``max_epochs`` times. Sources above that cap are clamped, and what they leave over is shared
again among the others by weight, until no source is above its cap. The last repetition of a
source is a fraction; it is filled with documents in the order of a seeded hash, so reruns
choose the same ones.

Scale: texts are read once, for their sizes. After that only (source, hash cell) sums move,
and they combine before the shuffle, so a source that holds a third of all rows is no hot
task. A cell is found in three steps of 1,024 cells each, so that no window ever sees more
than 1,024 rows, and what the driver sees of a round is one row of totals.

Defined results: null text has size 0; the null source is a source of its own, ordered last;
rows that repeat a doc_id fall in the same hash cell and are taken alike; an empty table gives
no rows; further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import range_scan, running_total
from .common import settle, unwrap, wrap

SEED = 17
MAX_EPOCHS = 3
CYCLE = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
# Three steps of ten bits each.
STEP_BITS, STEPS = 10, 3


def word_count(column: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(column: str = "source") -> Column:
    """A source as text that is never null and sorts like the source, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(column)), F.lit("1"))


def hash_cell(seed: int, column: str = "doc_id") -> Column:
    """A seeded value below 2^30 for a document."""
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return F.shiftright(F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("bigint"), 2)


def cycle_weights(cycle: tuple[int, ...] = CYCLE) -> Callable[[DataFrame], DataFrame]:
    """Weights that repeat along the sources in code point order."""

    def weigh(sources: DataFrame) -> DataFrame:
        # Levels of growing prefixes: no window sees all sources at once.
        levels = {"_p1": F.substring("_source", 1, 3), "_p2": F.substring("_source", 1, 8)}
        numbered = running_total(
            sources.withColumns({**levels, "_one": F.lit(1)}), [], [*levels, "_source"], {"_n": "_one"}
        )
        choice = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("_n") % len(cycle) + 1).cast("int"))
        return numbered.withColumn("_weight", choice.cast("bigint")).drop(*levels, "_one", "_n")

    return weigh


def fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add ``_target`` to sources (_source, _words, _weight): clamp, share again, until feasible.

    In the order of cap per weight the sources that are clamped come first: one is if its share
    of what the caps before it leave is above its cap. The first that is not sets the level for
    itself and all after it, so one scan over ranges of that order takes the place of rounds.
    Sums and products are decimals of 38 digits.
    """
    wide = "decimal(38,0)"
    ranked = sources.withColumns(
        {"_w": F.col("_weight").cast(wide), "_cap": F.col("_words").cast(wide) * F.lit(max_epochs).cast("decimal(10,0)")}
    ).withColumns({"_cap": F.col("_cap").cast(wide), "_rate": F.col("_cap").cast("double") / F.col("_w").cast("double")})
    total = ranked.agg(F.sum("_words").cast(wide).alias("words"), F.sum("_w").cast(wide).alias("weight")).first()
    words, weight = (F.lit(v if v is not None else 0).cast(wide) for v in total)
    scanned = range_scan(ranked, [], ["_rate", "_source"], {"_caps": "_cap", "_weights": "_w"})
    none = F.lit(0).cast(wide)
    left = scanned.withColumns(
        {"_rest": (words - F.coalesce("_caps", none)).cast(wide), "_spread": (weight - F.coalesce("_weights", none)).cast(wide)}
    )
    left = settle(left.withColumn("_above", F.col("_w") * F.col("_rest") > F.col("_cap") * F.col("_spread")))
    level = left.where("NOT _above").agg(F.min(F.struct("_rate", "_source", "_rest", "_spread")).alias("_l")).first()[0]
    rest, spread = (F.lit(level[k] if level else 1).cast(wide) for k in ("_rest", "_spread"))
    share = (F.col("_w") * rest).cast("double") / spread.cast("double")
    # A source at its cap and one after it may stand in either order: the level decides, not the place.
    above = F.lit(True) if level is None else F.col("_w") * rest > F.col("_cap") * spread
    target = F.when(above, F.col("_cap").cast("double")).otherwise(share)
    return left.select(*sources.columns, target.alias("_target"))


def decide(
    sized: DataFrame,
    weigh: Callable[[DataFrame], DataFrame] | None = None,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """One row per source: words, target, whole repetitions and the cell the fraction ends at.

    ``sized`` is a settled frame of (_source, _words, _cell), one row per document.
    """
    totals = sized.groupBy("_source").agg(F.sum("_words").alias("_words"))
    weighed = settle((weigh or cycle_weights())(settle(totals)))
    whole = F.when(F.col("_words") > 0, F.floor(F.col("_target") / F.col("_words"))).otherwise(0)
    sources = fill(weighed, max_epochs).withColumn("_whole", whole.cast("bigint"))
    sources = settle(sources.withColumn("_need", F.col("_target") - F.col("_whole") * F.col("_words")))
    # Descend to the cell where the fraction ends; base is the sum of all cells before it.
    at = sources.select("_source", "_need", F.lit(0).cast("bigint").alias("_base"), F.lit(0).cast("bigint").alias("_at"))
    for step in range(1, STEPS + 1):
        shift = STEP_BITS * (STEPS - step)
        inside = F.shiftright("_cell", shift + STEP_BITS) == F.col("_at")
        sums = (
            sized.join(at.select("_source", "_at"), "_source").where(inside)
            .groupBy("_source", F.shiftright("_cell", shift).alias("_part"))
            .agg(F.sum("_words").alias("_sum"))
        )
        before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        run = sums.join(at, "_source").withColumn(
            "_base", F.col("_base") + F.coalesce(F.sum("_sum").over(before), F.lit(0))
        )
        over = (
            F.col("_base") + F.col("_sum") > F.col("_need")
            if step < STEPS
            else 2 * F.col("_base") + F.col("_sum") > 2 * F.col("_need")
        )
        first = run.where(over).groupBy("_source").agg(
            F.min(F.struct("_part", "_base")).alias("_first"), F.first("_need").alias("_need")
        )
        found = first.select(
            "_source", "_need", F.col("_first._base").alias("_base"), F.col("_first._part").alias("_at")
        )
        if step == STEPS:
            # All cells of the block taken: the end is the next block's first cell.
            block = at.select("_source", (F.shiftleft("_at", STEP_BITS) + (1 << STEP_BITS)).alias("_end"))
            found = block.join(found.select("_source", "_at"), "_source", "left").select(
                "_source", F.coalesce("_at", "_end").alias("_at")
            )
        at = settle(found)
    return sources.join(at.select("_source", F.col("_at").alias("_until")), "_source", "left").select(
        "_source", F.col("_words").alias("_source_words"), "_target", "_whole", "_until"
    )


def repeats() -> Column:
    """How often a document is taken, from the decision of its source and its own cell."""
    fraction = F.coalesce(F.col("_cell") < F.col("_until"), F.lit(False)).cast("bigint")
    return F.coalesce(F.col("_whole"), F.lit(0)) + fraction


def size_up(docs: DataFrame, seed: int = SEED, text: str = "text") -> DataFrame:
    """The narrow facts the decisions need, written once: source, words and hash cell."""
    return settle(
        docs.select(
            "doc_id",
            source_key().alias("_source"),
            word_count(text).alias("_words"),
            hash_cell(seed).alias("_cell"),
        )
    )


def mix(
    docs: DataFrame,
    weigh: Callable[[DataFrame], DataFrame] | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The mixed corpus: every document as many times as the mix takes it, same columns."""
    decided = decide(size_up(docs, seed), weigh, max_epochs)
    keyed = wrap(docs, _source=source_key(), _cell=hash_cell(seed))
    taken = keyed.join(decided, "_source").where(repeats() > 0)
    return unwrap(taken.select("_row", F.explode(F.sequence(F.lit(1), repeats().cast("int")))), docs)


def mixing_report(
    docs: DataFrame,
    weigh: Callable[[DataFrame], DataFrame] | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    sized = size_up(docs, seed)
    return sized.join(decide(sized, weigh, max_epochs), "_source").select(
        "doc_id",
        F.col("_words").alias("size"),
        F.col("_source_words").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_words") * repeats()).alias("taken"),
    )
