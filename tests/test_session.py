"""Settings that bound what one task reads."""

from pyspark.sql import functions as F

from gearledger import session
from gearledger.llm import common
from gearledger.sources.mapping import RentalTables


def test_rental_tables_bound_what_a_task_reads(spark, folder):
    """the memory of a task follows its share, not the tables."""
    RentalTables(spark, folder)
    for key, value in session.TASK_BYTES.items():
        assert spark.conf.get(key) == value
    common.prepare(spark)
    for key, value in session.TASK_BYTES.items():
        assert spark.conf.get(key) != value


def test_operators_keep_the_settings_a_session_began_with(spark, folder):
    """r03, pipeline and op3_token_output: tasks of the size the session names, not Spark's default of 128 MB."""
    own = spark.newSession()
    for key in session.TASK_BYTES:
        own.conf.set(key, "5m")
    common.prepare(own)
    assert {own.conf.get(key) for key in session.TASK_BYTES} == {"5m"}
    RentalTables(own, folder)
    RentalTables(own, folder)
    assert {key: own.conf.get(key) for key in session.TASK_BYTES} == session.TASK_BYTES
    common.prepare(own)
    assert {own.conf.get(key) for key in session.TASK_BYTES} == {"5m"}


def test_joins_judge_a_table_by_its_rows_not_by_its_file(spark, folder, tmp_path):
    """a small file of many rows went through the driver as a hash table."""
    own = spark.newSession()
    path = str(tmp_path / "packed")
    own.range(1_500_000, numPartitions=1).selectExpr("xxhash64(id) % 1000 AS k", "1 AS n").write.parquet(path)
    RentalTables(own, folder)
    packed = own.read.parquet(path)
    plan = packed.alias("a").join(packed.alias("b"), "k")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # What is small stays so, and the operators get their own settings back.
    small = own.read.parquet(f"{folder}/supplier.parquet")
    assert "Broadcast" in packed.join(small, F.col("k") == F.col("s_suppkey"))._jdf.queryExecution().sparkPlan().toString()
    common.prepare(own)
    assert own.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0"


def test_what_rental_queries_leave_on_disk(spark, folder, tmp_path):
    """shuffle files stayed until the driver's next collection, and settled tables were packed lightly."""
    own = spark.newSession()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own.conf.set(key, "false")
    RentalTables(own, folder)
    assert own.conf.get(key) == "true"

    def codecs():
        files = session.settle(own.range(10)).inputFiles()
        return {f.split(".")[-2] for f in files}

    assert codecs() == {"zstd"}
    common.prepare(own)
    assert codecs() == {own.conf.get("spark.sql.parquet.compression.codec")}
