"""Structured Streaming jobs: the audit log of a change feed and running rental totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.audit import audit_columns
from ..session import new_path


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet folder or file as a stream, with the schema of the files there now."""
    # A file source takes a single file only through a pattern; this one matches one name.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return (
        spark.readStream.schema(spark.read.parquet(path).schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(pattern)
    )


def audit_log(changes: DataFrame, table: str, thing: str) -> DataFrame:
    """Log rows of a change feed (op, record_id, label, change_time); stateless."""
    return changes.select(*audit_columns(table, thing, F.col("change_time")))


def run_audit(changes: DataFrame, table: str, thing: str) -> DataFrame:
    """Drain the feed into a log in the shared folder (exactly once) and read it back."""
    spark = changes.sparkSession
    log, state = new_path(spark, "audit-log"), new_path(spark, "audit-state")
    query = (
        audit_log(changes, table, thing)
        .writeStream.format("parquet")
        .option("path", log)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # The log's schema is known, so a feed without files gives no rows.
    return spark.read.schema(audit_log(changes, table, thing).schema).parquet(made(spark, log))


def made(spark: SparkSession, path: str) -> str:
    """A folder that may not have been written because nothing came."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return path


def rental_totals(changes: DataFrame) -> DataFrame:
    """Running total per rental from item changes (rental_id, old_subtotal, new_subtotal).

    An insert has no old and a delete no new subtotal. A rental can change at any time, so
    its total never closes and there is no watermark.
    """
    zero = C.dec(0, 10, 2)
    delta = F.coalesce("new_subtotal", zero) - F.coalesce("old_subtotal", zero)
    return changes.groupBy("rental_id").agg(F.sum(delta).alias("total_amount"))


def run_totals(changes: DataFrame) -> DataFrame:
    """Drain the feed; every batch writes its changed totals, the latest one counts.

    A batch overwrites its own folder, so a repeated batch after a failure changes nothing.
    """
    spark = changes.sparkSession
    out, state = new_path(spark, "totals"), new_path(spark, "totals-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # Totals never close, so their state grows with the rentals: on disk, not in the heap.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    totals = rental_totals(changes)
    query = (
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", state)
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    fields = f"{', '.join(f'{n} {k}' for n, k in totals.dtypes)}, batch long"
    return (
        spark.read.schema(fields).parquet(made(spark, out))
        .groupBy("rental_id")
        .agg(F.max_by("total_amount", "batch").alias("total_amount"))
    )
