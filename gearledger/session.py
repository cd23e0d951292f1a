"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# How settled tables are packed; the session's own way where it is not set.
CODEC_KEY = "gearledger.settled.codec"


def local_session(cpus: int | str = 8, app: str = "gearledger", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Plans rely on these: a join may meet a key that holds a third of all rows, and splitting it
# has to be allowed even where the next step would have liked to keep the partitioning.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffle files go when the job that wrote them has ended: what is used again is settled.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

# A file holds its rows packed, up to some thirty times smaller than the hash table that a driver
# would build of them: joins judge a table by what it unpacks to, or by what a shuffle has
# counted, so that no table that grows with the data is sent through the driver.
TABLE_SIZES = {"spark.sql.sources.fileCompressionFactor": "32.0"}

# What one task reads of a file or of a shuffle. A hash table or a sort holds several times
# that, four of them share an executor, and what a task needs may not grow with the tables.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def tune(spark: SparkSession) -> None:
    """Set the adaptive options the plans rely on, for this session."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)


def small_tasks(spark: SparkSession, small: bool = True) -> None:
    """Bound what one task reads, the driver sends out and settled tables fill, for this session,
    or go back to the settings it began with.

    Those are kept in the session: to unset a key would give Spark's default, not what the
    session was built with.
    """
    for key, value in (TASK_BYTES | TABLE_SIZES).items():
        kept = f"gearledger.before.{key}"
        before = spark.conf.get(kept, None)
        if small:
            if before is None:
                spark.conf.set(kept, spark.conf.get(key))
            spark.conf.set(key, value)
        elif before is not None:
            spark.conf.set(key, before)
            spark.conf.unset(kept)
    if small:
        spark.conf.set(CODEC_KEY, "zstd")
    else:
        spark.conf.unset(CODEC_KEY)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a session that names none.

    The folder is read from the session. A fallback is made only for local masters: on a
    cluster a machine-local folder would vanish with its executor, so that is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = named or spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="gearledger-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, never reused."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def settle(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back: the lineage ends there."""
    path = new_path(df.sparkSession, "settled")
    conf = df.sparkSession.conf
    codec = conf.get(CODEC_KEY, None) or conf.get("spark.sql.parquet.compression.codec")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
