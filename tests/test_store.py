"""Reading and writing tables, and the plans a scan gets."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from gearledger import catalog
from gearledger.plans import lookups, views
from gearledger.sources import store
from gearledger.sources.mapping import MAPPING, RentalTables
from gearledger.sources.seed import seed_rows, seed_table


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    for table in seed_rows():
        store.write_table(seed_table(spark, table), path, table)
    return path


def plan_of(df):
    # Long filter lists are cut in plan texts by default.
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip_and_no_overwrite(spark, root):
    assert [len(v) for v in seed_rows().values()] == [1, 10, 5, 6, 22, 3, 22]
    for table, rows in seed_rows().items():
        assert store.read_table(spark, root, table, "string").count() == len(rows)
    with pytest.raises(Exception, match="already exists"):
        store.write_table(seed_table(spark, "taxes"), root, "taxes")


def test_filters_and_columns_reach_the_scan(spark, root):
    equipments = store.read_table(spark, root, "equipments", "string")
    plan = plan_of(lookups.equipment_by_type(equipments, "MAIN", "AVAILABLE"))
    assert "EqualTo(equipment_type,MAIN)" in plan and "EqualTo(status,AVAILABLE)" in plan
    assert "purchase_price" not in plan.split("ReadSchema")[1]
    customers = store.read_table(spark, root, "customers", "string")
    plan = plan_of(lookups.customers_in_box(customers, 10.7, 10.8, 106.6, 106.7))
    assert "GreaterThanOrEqual(latitude" in plan and "LessThanOrEqual(longitude" in plan


def test_partitioned_table_prunes(spark, tmp_path):
    log = RentalTables(spark, "/root/testdata/sf0.001")["system_log"].withColumn(
        "day", F.to_date("action_time"))
    store.write_table(log, str(tmp_path), "system_log", partition_by="day")
    back = spark.read.parquet(f"{tmp_path}/system_log")
    assert back.count() == log.count()
    assert "PartitionFilters: [isnotnull(day" in plan_of(back.where("day = DATE '2024-01-05'"))


def test_clean_text(spark):
    df = spark.createDataFrame([("E1   ", "", 1)], "equipment_id string, note string, n int")
    assert store.clean_text(df).first() == ("E1", None, 1)


def test_defaults_only_for_omitted_columns(spark):
    batch = spark.createDataFrame([("IV1", 5, 5, None, "EQ001")],
        "inventory_id string, total_quantity int, available_quantity int, lost_quantity int, equipment_id string")
    row = store.with_defaults(batch, "inventory", AS_OF, "string").first()
    assert row.rented_quantity == 0 and row.lost_quantity is None
    assert row.last_updated == dt.datetime(2024, 7, 1)


def test_upsert_sets_null_too(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "k int, v string, w int")
    changes = spark.createDataFrame([(1, None), (3, "c"), (9, "z")], "k int, v string")
    got = sorted(tuple(r) for r in store.upsert(current, changes, "k").collect())
    assert got == [(1, None, 1), (2, "b", 2), (3, "c", 3)]


def test_guarded_delete(spark):
    current = spark.createDataFrame([("A",), ("B",), ("C",)], "rental_id string")
    items = spark.createDataFrame([("B",), ("B",)], "rental_id string")
    invoices = spark.createDataFrame([("B",), ("C",)], "rental_id string")
    kept, decision = store.delete(current, current, "rental_id", [
        (items, "rental_id", ("rental_delete", -20062)), (invoices, "rental_id", ("rental_delete", -20063))])
    assert {r.rental_id for r in kept.collect()} == {"B", "C"}
    assert {(r.key, r.code) for r in decision.rejects.collect()} == {("B", -20062), ("C", -20063)}


def rows_scanned(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_box_reads_only_files_of_near_places(spark, tmp_path):
    spots = spark.range(6400).selectExpr(
        "id AS customer_id",
        "CASE WHEN id % 3 > 0 THEN cast(10 + (id * 7919 % 6400) / 6400 AS decimal(9,6)) END AS latitude",
        "cast(106 + (id * 104729 % 6389) / 6389 AS decimal(9,6)) AS longitude")
    store.write_table(spots.repartition(64), str(tmp_path), "any")
    store.write_by_place(spots, str(tmp_path), "near", 64)
    found = {}
    for name in ("any", "near"):
        box = lookups.customers_in_box(spark.read.parquet(f"{tmp_path}/{name}"), 10.1, 10.2, 106.1, 106.2)
        found[name] = sorted(map(tuple, box.collect())), rows_scanned(box)
    assert found["any"][0] == found["near"][0] and found["near"][0]
    assert found["any"][1] == 6400 and found["near"][1] <= 6400 / 4
    sizes = [r[1] for r in spark.read.parquet(f"{tmp_path}/near").groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 6400 / 16  # a third of the rows has no place


def test_place_codes(spark):
    row = spark.sql("SELECT 1").select(
        *[store.place(F.lit(a).cast("double"), F.lit(b).cast("double")).alias(str(i))
          for i, (a, b) in enumerate([(-90, -180), (90, 180), (-90, 0), (0, -180), (None, 1)])]).first()
    assert tuple(row) == (0, 2**32 - 1, 2**30, 2**31, None)


def parts_of(path):
    """The files of every part and the time they were written."""
    parts = {}
    for file in Path(path).rglob("*.parquet"):
        parts.setdefault(file.parent.name, set()).add((file.name, file.stat().st_mtime_ns))
    return parts


def changed(before, after):
    return {part for part in before.keys() | after.keys() if before.get(part) != after.get(part)}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_upsert_rewrites_only_touched_parts(spark, tmp_path, kind):
    current = spark.range(2000).selectExpr(f"cast(id AS {kind}) AS k", "id % 7 AS v", "'x' AS w")
    changes = spark.range(10).selectExpr("id * 211 AS k", "CASE WHEN id <> 3 THEN -id END AS v")
    path = store.write_keyed(current, str(tmp_path), "t", "k", 100)
    before = parts_of(path)
    touched = store.upsert_keyed(path, changes, "k")
    assert len(before) == 100 and 0 < len(touched) <= 10
    assert changed(before, parts_of(path)) == {f"part_of_100={n}" for n in touched}
    wanted = store.upsert(current, changes.withColumn("k", F.col("k").cast(kind)), "k")
    got = store.read_keyed(spark, path).select("k", "v", "w")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    assert store.upsert_keyed(path, changes.where("k < 0"), "k") == []


def test_keyed_delete_of_whole_parts_and_of_all_rows(spark, tmp_path):
    current = spark.range(40).selectExpr("id AS k", "cast(id AS string) AS v")
    path = store.write_keyed(current, str(tmp_path), "t", "k", 100)
    before = parts_of(path)
    child = spark.createDataFrame([(4,), (4,), (5,)], "parent bigint")
    touched, decision = store.delete_keyed(
        path, current.where("k < 6"), "k", [(child, "parent", ("rental_delete", -20062))])
    assert {r.k for r in store.read_keyed(spark, path).collect()} == set(range(4, 40))
    assert {(r.key, r.code) for r in decision.rejects.collect()} == {("4", -20062), ("5", -20062)}
    assert len(touched) <= 4 and changed(before, parts_of(path)) == {f"part_of_100={n}" for n in touched}
    store.delete_keyed(path, current, "k")
    assert store.read_keyed(spark, path).count() == 0
    assert store.read_keyed(spark, path).columns == ["k", "v"]


def test_keyed_table_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "k bigint, v string")
    path = store.write_keyed(empty, str(tmp_path), "t", "k", 10)
    assert store.read_keyed(spark, path).schema == empty.schema
    assert store.upsert_keyed(path, spark.createDataFrame([(1, "a")], "k bigint, v string"), "k") != []
    assert store.read_keyed(spark, path).count() == 0  # an upsert changes rows that are there


def test_view_plans_read_only_what_they_show(spark, folder):
    t = RentalTables(spark, folder)
    plan = plan_of(views.inventory_status(t["inventory"], t["equipments"], t["rental_items"]))
    assert "Window" not in plan  # the unused item id costs nothing
    assert "l_extendedprice" not in plan and "p_retailprice" not in plan


def test_outer_view_keeps_empty_rentals(spark, folder):
    t = RentalTables(spark, folder)
    view = views.rental_details(
        t["rentals"], t["customers"], t["employees"], t["rental_items"], t["equipments"])
    empty = t["rentals"].join(t["rental_items"], "rental_id", "left_anti").count()
    assert empty > 0 and view.where("rental_item_id IS NULL").count() == empty


def test_table_scan_numbers_the_items_once(spark, folder):
    """six of the eighteen tables numbered and priced the lines of the orders, each for itself."""
    plan = catalog.queries()["src1_table_scan"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_commands_to_create_rentals_move_few_columns(spark, folder):
    """the lines were numbered with eleven columns, and moved for the equipments before their orders."""
    tables = RentalTables(spark, folder)
    got = tables["create_rental_commands"]
    text = MAPPING["create_rental_commands"]
    want = spark.sql(text, rental_items=tables["rental_items"], rentals=tables["rentals"])
    assert got.schema == want.schema and got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "l_extendedprice" not in got._jdf.queryExecution().sparkPlan().toString()


def test_lines_that_differ_behind_the_quantity_give_the_same_commands(spark, folder, tmp_path):
    """repeated lines, equal or not, lines of unknown orders or parts, parts that come twice, null keys."""
    for name in ("supplier", "orders", "part", "lineitem"):
        rows = spark.read.parquet(f"{folder}/{name}.parquet").limit(400)
        if name == "lineitem":
            rows = rows.withColumns({
                "l_partkey": F.when(F.col("l_linenumber") < 6, F.col("l_partkey") % 7), "l_orderkey": F.col("l_orderkey") % 20})
            rows = rows.unionByName(rows.withColumn("l_tax", F.col("l_tax") + 1)).unionByName(rows)
        if name == "part":
            rows = rows.unionByName(rows.where("p_partkey % 5 = 0"))
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    tables = RentalTables(spark, str(tmp_path))
    got = tables["create_rental_commands"]
    want = spark.sql(MAPPING["create_rental_commands"], rental_items=tables["rental_items"], rentals=tables["rentals"])
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
