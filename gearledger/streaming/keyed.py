"""Stateful streams: guarded deletes of a change feed, and results that follow inserts and deletes.

Both work on whole micro-batches by joins, windows and aggregations; no key has a Python call of
its own. The state of the guards is a table of counts next to the checkpoint, one folder per
batch; that of the results is a streaming aggregation over a RocksDB store. A repeated batch
overwrites its own folders, so the sinks are exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import Guards, guard_events, guarded_rows
from ..operators.numbering import range_scan
from ..operators.rejects import Decision
from ..session import new_path
from .jobs import STATE_STORE, made

GUARDED = "record_id long, op string, label string, change_time timestamp_ntz, guard int"
TRACKED = "key long, value long, left long, total long"
# Batches after which the counts of all batches so far are written together.
FOLD = 16


def _held(spark: SparkSession, counts: str, batch_id: int, names: list[str]) -> DataFrame:
    """Children per record and guard that the batches before ``batch_id`` left: the last fold and what came since."""
    since = batch_id - batch_id % FOLD
    paths = [f"{counts}/net-{b}" for b in range(since, batch_id)] + ([f"{counts}/fold-{since}"] if since else [])
    fields = ", ".join(["record_id long", *[f"{n} long" for n in names]])
    if not paths:
        return spark.createDataFrame([], fields)
    return _net(spark.read.schema(fields).parquet(*paths), {n: F.col(n) for n in names})


def _net(rows: DataFrame, deltas: dict) -> DataFrame:
    """Sums per record, without records whose sums are all zero."""
    sums = rows.groupBy("record_id").agg(*[F.sum(d).alias(n) for n, d in deltas.items()])
    return sums.where(F.greatest(F.lit(0), *[F.abs(n) for n in deltas]) > 0)


def guard_batch(events: DataFrame, held: DataFrame, guards: Guards) -> DataFrame:
    """Changes of one batch with the number of the guard that refuses them, or -1.

    Events count in the order of their time (without one: last), children first, after what is
    ``held`` from earlier batches. The counts are a running sum, scanned in ranges, so a record
    of very many children is split.
    """
    names = [f"_d{i}" for i in range(len(guards))]
    deltas = {n: F.when(F.col("guard") == i, F.col("delta")).otherwise(0) for i, n in enumerate(names)}
    here = events.withColumns(deltas)
    asked = here.where("kind = 1 AND op = 'D'").select(F.col("record_id").alias("_r")).distinct()
    before = held.join(asked, F.col("record_id").eqNullSafe(F.col("_r")), "left_semi").withColumn("kind", F.lit(-1))
    order = [F.col("kind") >= 0, F.col("change_time").isNull(), "change_time", "kind"]
    rows = here.unionByName(before, allowMissingColumns=True)
    scanned = range_scan(rows, ["record_id"], order, {f"_n{i}": n for i, n in enumerate(names)}).where("kind = 1")
    first = F.coalesce(*[F.when((F.col("op") == "D") & (F.col(f"_n{i}") > 0), i) for i in range(len(guards))], F.lit(-1))
    return scanned.select("record_id", "op", "label", "change_time", first.cast("int").alias("guard"))


def run_guarded_audit(
    changes: DataFrame, children: DataFrame, table: str, thing: str, guards: Guards,
    log: str | None = None, state: str | None = None,
) -> Decision:
    """Drain both feeds into a log of decided changes; ``log`` and ``state`` go on with earlier ones.

    ``children``: (guard, op, record_id, change_time), a child that comes to or leaves a record.
    Events of one batch count in the order of their time, children first; those of a later
    batch come after them.
    """
    spark = changes.sparkSession
    log, state = log or new_path(spark, "guarded-log"), state or new_path(spark, "guarded-state")
    counts, names = f"{state}-counts", [f"_d{i}" for i in range(len(guards))]

    def keep(batch: DataFrame, batch_id: int) -> None:
        # Written once and read in the caller's session, whose plans are adaptive.
        path = new_path(spark, "guarded-batch")
        batch.write.parquet(path)
        events, held = spark.read.schema(batch.schema).parquet(path), _held(spark, counts, batch_id, names)
        guard_batch(events, held, guards).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        deltas = {n: F.when(F.col("guard") == i, F.col("delta")).otherwise(0) for i, n in enumerate(names)}
        _net(events.where("kind = 0"), deltas).write.mode("overwrite").parquet(f"{counts}/net-{batch_id}")
        if (batch_id + 1) % FOLD == 0:
            both = held.unionByName(spark.read.schema(held.schema).parquet(f"{counts}/net-{batch_id}"))
            _net(both, {n: F.col(n) for n in names}).write.mode("overwrite").parquet(f"{counts}/fold-{batch_id + 1}")

    query = (
        guard_events(changes, children)
        .writeStream.outputMode("append")
        .option("checkpointLocation", state)
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    decided = spark.read.schema(GUARDED).parquet(made(spark, log))
    used = [F.col("guard") == i for i in range(len(guards))]
    return guarded_rows(decided, used, table, thing, guards)


def tracked(changes: DataFrame) -> DataFrame:
    """Per key and value, after each batch that touches it: rows that are left and their total amount.

    ``changes``: (key, sign, value, amount); sign is 1 for a row that comes and -1 for one that
    goes, an update is both. A delete may come before its insert: what is owed stays as a
    negative count.
    """
    return changes.groupBy("key", "value").agg(
        F.sum("sign").alias("left"), F.sum(F.col("sign") * F.col("amount")).alias("total")
    )


def run_tracked(changes: DataFrame, out: str | None = None, state: str | None = None) -> DataFrame:
    """Drain the feed and return (key, n, total, latest) of the keys that have rows left.

    Deleting the latest value brings the one before it back. ``out`` and ``state`` go on with
    earlier ones.
    """
    spark = changes.sparkSession
    # The state grows with the keys and their values: on disk, not in the heap.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out, state = out or new_path(spark, "tracked"), state or new_path(spark, "tracked-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        tracked(changes).writeStream.outputMode("update")
        .option("checkpointLocation", state)
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = spark.read.schema(f"{TRACKED}, batch long").parquet(made(spark, out))
    last = written.groupBy("key", "value").agg(F.max_by(F.struct("left", "total"), "batch").alias("_l"))
    return last.groupBy("key").agg(
        F.sum("_l.left").alias("n"), F.sum("_l.total").alias("total"),
        F.max(F.when(F.col("_l.left") > 0, F.col("value"))).alias("latest"),
    ).where("n > 0")


def row_changes(rows: DataFrame, key: str, value: str, amount: str, ops: str = "op") -> DataFrame:
    """Signed changes from rows of inserts (I) and deletes (D) with a time and an amount of money.

    Times become microseconds, amounts cents; both are exact.
    """
    micros = F.unix_micros(F.col(value).cast("timestamp"))
    return rows.select(
        F.col(key).cast("long").alias("key"),
        F.when(F.col(ops) == "D", -1).otherwise(1).cast("long").alias("sign"),
        micros.alias("value"),
        (F.col(amount) * 100).cast("long").alias("amount"),
    )


def as_results(kept: DataFrame, key: str, value: str, amount: str) -> DataFrame:
    """Tracked results back in the types of the rows."""
    return kept.select(
        F.col("key").alias(key), F.col("n").alias("rows"),
        (F.col("total").cast("decimal(20,0)") / 100).cast("decimal(20,2)").alias(amount),
        F.timestamp_micros("latest").cast("timestamp_ntz").alias(value),
    )
