"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, small_tasks, tune

__all__ = ["load", "prepare", "settle", "text_mark", "unwrap", "whole_text", "wrap"]

# Rows handed to a Python worker at once: with texts of some megabytes each, a batch still
# fits a worker.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Adaptive joins that split hot keys, Arrow batches that stay small, and shuffle files that
    go when the job that wrote them has ended: results that are used again are settled tables."""
    tune(spark)
    small_tasks(spark, False)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables."""
    prepare(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as it is, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_mark(column: str = "text", key: str = "doc_id") -> Column:
    """63 bits of the text's SHA-256, which tell texts under one id apart; below zero where there is an id.

    Texts without an id share the largest id; they sort after those that really have it.
    """
    digest = F.sha2(whole_text(column), 256)
    bits = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    more = F.conv(F.substring(digest, 16, 1), 16, 10).cast("bigint").bitwiseAND(F.lit(7))
    mark = F.shiftleft(bits, 3).bitwiseOR(more)
    return F.when(F.col(key).isNull(), mark).otherwise(mark.bitwiseXOR(F.lit(-(1 << 63))))


def wrap(docs: DataFrame, **added: Column) -> DataFrame:
    """The rows as one column ``_row`` and new columns beside it, whatever the rows' names are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, *[value.alias(name) for name, value in added.items()])


def unwrap(wrapped: DataFrame, docs: DataFrame) -> DataFrame:
    """Back to the columns of the documents."""
    return wrapped.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
