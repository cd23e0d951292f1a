"""Rental tables on disk: scans, appends with defaults, keyed upserts and guarded deletes.

``append``, ``upsert`` and ``delete`` return the new table, and ``write_table`` puts it in a new
folder. A table written by ``write_keyed`` lies in parts by the hash of its key; ``upsert_keyed``
and ``delete_keyed`` read and rewrite only the parts that hold a changed key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.rejects import Decision, first_refusal, refuse
from ..session import settle
from .schemas import DEFAULTS, columns, schema


def read_table(
    spark: SparkSession, root: str, table: str, id_type: str = "bigint"
) -> DataFrame:
    """Scan one table with its declared schema; filters and columns reach the files."""
    return spark.read.schema(schema(table, id_type)).parquet(f"{root}/{table}")


def clean_text(df: DataFrame) -> DataFrame:
    """For loading foreign rows: empty text becomes NULL and padded ids are trimmed.

    Done once before a table is written, so that later filters stay plain column filters.
    """
    cleaned = {}
    for name, kind in df.dtypes:
        if kind == "string":
            text = F.rtrim(name) if name.endswith("_id") else F.col(name)
            cleaned[name] = F.nullif(text, F.lit(""))
    return df.withColumns(cleaned) if cleaned else df


def write_table(df: DataFrame, root: str, table: str, partition_by: str | None = None) -> str:
    """Write a table to a folder that must not exist yet."""
    path = f"{root}/{table}"
    writer = df.write.mode("errorifexists")
    if partition_by is not None:
        # One range of the partition column per task keeps the number of files low.
        writer = df.repartitionByRange(partition_by).write.mode("errorifexists").partitionBy(
            partition_by
        )
    writer.parquet(path)
    return path


def with_defaults(
    batch: DataFrame, table: str, as_of: str | dt.datetime, id_type: str = "bigint"
) -> DataFrame:
    """Complete an insert batch: omitted columns get their default or NULL.

    A column that is present keeps its NULLs, as an explicit NULL does in an insert.
    """
    defaults = DEFAULTS.get(table, {})

    def column(name: str, kind: str) -> Column:
        if name in batch.columns:
            return F.col(name).cast(kind).alias(name)
        if defaults.get(name) == "now":
            return C.clock(as_of).alias(name)
        return F.lit(defaults.get(name)).cast(kind).alias(name)

    return batch.select(*[column(c.name, c.type) for c in columns(table, id_type)])


def append(current: DataFrame, batch: DataFrame, table: str, as_of: str) -> DataFrame:
    """The table after an insert batch."""
    return current.unionByName(with_defaults(batch, table, as_of))


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Set the columns of ``changes`` on the rows with its keys (one change per key)."""
    fields = [c for c in changes.columns if c != key]
    marked = changes.select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields]
    )
    kinds = dict(current.dtypes)
    joined = current.join(marked, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}").cast(kinds[c])).otherwise(F.col(c)).alias(c)
            if c in fields
            else F.col(c)
            for c in current.columns
        ]
    )


def delete(
    current: DataFrame,
    keys: DataFrame,
    key: str,
    guards: list[tuple[DataFrame, str, tuple[str, int]]] = (),
) -> tuple[DataFrame, Decision]:
    """Delete rows by key unless a guarded child row exists.

    Returns the remaining table and the decision over the asked keys that were found.
    """
    asked = current.select(key).join(keys.select(key), key, "left_semi")
    rules = []
    for i, (child, foreign, refusal) in enumerate(guards):
        used = child.groupBy(F.col(foreign).alias(key)).agg(F.lit(True).alias(f"_g{i}"))
        asked = asked.join(used, key, "left")
        rules.append((F.col(f"_g{i}").isNotNull(), refuse(*refusal)))
    refusal = first_refusal(*rules) if rules else F.lit(None).cast("struct<source:string,code:int>")
    decision = Decision(asked.select(key, refusal.alias("refusal")), key)
    kept = current.join(decision.accepted.select(key), key, "left_anti")
    return kept, decision


PLACE_BITS = 16  # bits of each coordinate in a place code: cells of about 300 m by 600 m


def place(latitude: Column, longitude: Column) -> Column:
    """Code of a place that takes the bits of both coordinates in turn; NULL if one is missing."""

    def cell(degrees: Column, span: int) -> Column:
        share = (degrees.cast("double") + span / 2) / span
        number = F.floor(share * (1 << PLACE_BITS)).cast("bigint")
        return F.when(degrees.isNotNull(), F.least(F.greatest(number, F.lit(0)), F.lit((1 << PLACE_BITS) - 1)))

    north, east = cell(latitude, 180), cell(longitude, 360)
    code = F.lit(0).cast("bigint")
    for bit in range(PLACE_BITS):
        for shift, number in ((0, east), (1, north)):
            one = F.shiftright(number, bit).bitwiseAND(1)
            code = code.bitwiseOR(F.shiftleft(one, 2 * bit + shift))
    return code


def write_by_place(df: DataFrame, root: str, table: str, files: int) -> str:
    """Write a table so that rows of near places share files, to a folder that must not exist yet.

    Files and row groups then cover small boxes of latitude and longitude, and a filter on
    both skips the others by the minima and maxima in their footers. Rows of one place, or
    without a place, spread over files by the hash of the row.
    """
    path = f"{root}/{table}"
    code = place(F.col("latitude"), F.col("longitude"))
    order = [code, F.xxhash64(*[F.col(c) for c in df.columns])]
    dealt = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.write.mode("errorifexists").parquet(path)
    return path


PART = "part_of_"  # the folder of a row names the number of parts too: part_of_100=17


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_keyed(df: DataFrame, root: str, table: str, key: str, parts: int) -> str:
    """Write a table in ``parts`` parts by the hash of its key, to a folder that must not exist yet.

    ``parts`` should grow with the table, so that a part stays at some hundred megabytes.
    """
    path, column = f"{root}/{table}", f"{PART}{parts}"
    dealt = df.withColumn(column, _part(F.col(key), parts)).repartition(parts, column)
    dealt.write.mode("errorifexists").partitionBy(column).parquet(path)
    # A file without rows states the columns of a table that has none yet.
    empty = df.sparkSession.createDataFrame([], df.schema)
    empty.write.mode("append").parquet(f"{path}/{column}=0")
    return path


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table written by ``write_keyed``, without the column of the parts."""
    stored = spark.read.parquet(path)
    return stored.drop(_part_column(stored))


def _part_column(stored: DataFrame) -> str:
    return next(c for c in stored.columns if c.startswith(PART))


def _rewrite_parts(
    path: str, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame]
) -> list[int]:
    """Replace the parts that hold one of the keys by ``change`` of their rows; their numbers.

    The new rows are written to the shared folder before a part is touched, and a repeated call
    with the same change gives the same rows, so that a job cut off while it replaces parts is
    run again. Parts left without rows become a file that only holds the columns.
    """
    spark = keys.sparkSession
    stored = spark.read.parquet(path)
    column = _part_column(stored)
    parts = int(column.removeprefix(PART))
    kind = dict(stored.dtypes)[key]
    # Hashes depend on the type, so keys are read as the stored type. At most one number per
    # part reaches the driver.
    of_keys = keys.select(_part(F.col(key).cast(kind), parts).alias("part"))
    touched = sorted(r.part for r in of_keys.distinct().collect())
    if not touched:
        return []
    rows = settle(change(stored.where(F.col(column).isin(touched))))
    left = {r[0] for r in rows.select(column).distinct().collect()}
    rows.repartition(column).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(column).parquet(path)
    for number in touched:
        if number not in left:
            empty = spark.createDataFrame([], rows.drop(column).schema)
            empty.write.mode("overwrite").parquet(f"{path}/{column}={number}")
    return touched


def upsert_keyed(path: str, changes: DataFrame, key: str) -> list[int]:
    """``upsert`` on a stored table; only the parts of the changed keys are read and rewritten."""
    return _rewrite_parts(path, changes, key, lambda rows: upsert(rows, changes, key))


def delete_keyed(
    path: str,
    keys: DataFrame,
    key: str,
    guards: list[tuple[DataFrame, str, tuple[str, int]]] = (),
) -> tuple[list[int], Decision]:
    """``delete`` on a stored table; only the parts of the deleted keys are read and rewritten.

    Returns the numbers of these parts and the decision over the asked keys that were found.
    """
    stored = read_keyed(keys.sparkSession, path)
    _, decision = delete(stored, keys, key, guards)
    decided = Decision(settle(decision.frame), key)
    gone = decided.accepted.select(key)
    return _rewrite_parts(path, gone, key, lambda rows: rows.join(gone, key, "left_anti")), decided
