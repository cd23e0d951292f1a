"""Values by time: what held at a moment, and what was in force on a date.

Both are one scan over ranges of the order (``numbering.range_scan``): the last value is a running
maximum of (time, value), so a popular key, or a single key, is split over as many ranges as it
fills, and no range join compares rows with intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import range_scan


def as_of(events: DataFrame, moments: DataFrame, key: list[str], time: str, order: list[str], values: list[str]) -> DataFrame:
    """The moments with the values of their key's last event at or before their time, NULL before the first.

    ``events``: key, time, ``order`` (tells events of one time apart, never NULL) and values;
    ``moments``: key, time and any other columns, but none of the values'. NULL keys match NULL.
    """
    rest = [c for c in moments.columns if c not in key and c != time]
    seen = F.struct(F.col(time), *[F.col(c) for c in order], *[F.col(v) for v in values])
    kept = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(True).alias("_one"))
    told = events.select(*key, time, F.lit(0).alias("_kind"), seen.alias("_seen"))
    asked = moments.select(*key, time, F.lit(1).alias("_kind"), kept.alias("_rest"))
    both = told.unionByName(asked, allowMissingColumns=True)
    scanned = range_scan(both, key, [time, "_kind"], {"_last": "_seen"}, F.max).where("_kind = 1")
    return scanned.select(
        *key, time, *[F.col("_rest")[c].alias(c) for c in rest], *[F.col("_last")[v].alias(v) for v in values]
    )


def elementary(ranges: DataFrame, start: str, end: str, rank: Column, value: Column) -> DataFrame:
    """(at, picked): from ``at`` to the next row's, the value of the least ``rank`` among the ranges that hold.

    Ranges include both ends; one that ends before it starts never holds. Where none holds,
    picked is NULL. A range is written once per boundary inside it: ranges are a table of terms,
    not of facts.
    """
    after = F.expr(f"{end} + INTERVAL '0.000001' SECOND")
    sound = ranges.where(F.col(start) <= F.col(end)).select(F.col(start).alias("_a"), after.alias("_b"), rank.alias("_rank"), value.alias("_value"))
    cuts = sound.select(F.explode(F.array("_a", "_b")).alias("at")).distinct().withColumn("_one", F.lit(1).cast("long"))
    placed = range_scan(cuts, [], ["at"], {"_n": "_one"}).select("at", F.coalesce("_n", F.lit(0).cast("long")).alias("_n"))
    first = placed.select(F.col("at").alias("_a"), F.col("_n").alias("_from"))
    last = placed.select(F.col("at").alias("_b"), F.col("_n").alias("_to"))
    held = sound.join(first, "_a").join(last, "_b").select("_rank", "_value", F.explode(F.expr("sequence(_from, _to - 1)")).alias("_n"))
    best = held.groupBy("_n").agg(F.min_by("_value", "_rank").alias("picked"))
    return placed.join(best, "_n", "left").select("at", "picked")


def in_force(rows: DataFrame, date: str, ranges: DataFrame, start: str, end: str, rank: Column, value: Column, out: str) -> DataFrame:
    """The rows with ``out``: the value of the least rank among the ranges that hold on their date."""
    terms = elementary(ranges, start, end, rank, value).select(F.col("at").alias(date), F.lit(0).alias("_order"), F.col("picked").alias(out))
    return as_of(terms, rows, [], date, ["_order"], [out])
