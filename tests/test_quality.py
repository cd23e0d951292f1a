"""Constraint rules: their number, and exactly the violations put into the rows."""

import pytest
from pyspark.sql import functions as F

from gearledger.operators import quality
from gearledger.sources import schemas
from gearledger.sources.seed import seed_rows, seed_table


def test_rule_counts():
    assert len(schemas.TABLES) == len(schemas.PRIMARY_KEYS) == 18
    assert len(schemas.UNIQUE) == 9
    assert len(schemas.FOREIGN_KEYS) == 20
    assert len(schemas.ENUMS) == 20
    assert len(schemas.FLAGS) == 2
    assert len(schemas.RANGES) == 10
    assert sum(len(d) for d in schemas.DEFAULTS.values()) == 17
    for table, column, *_ in (*schemas.UNIQUE, *schemas.FOREIGN_KEYS, *schemas.ENUMS, *schemas.FLAGS):
        assert column in [c.name for c in schemas.columns(table)]


def test_required_columns_beside_keys():
    required = [
        (t, c.name) for t in schemas.TABLES for c in schemas.columns(t)
        if c.required and c.name not in schemas.PRIMARY_KEYS[t]
    ]
    # 110 columns are declared NOT NULL; both parts of the two-column key are among them.
    assert len(required) + 2 == 110


@pytest.fixture(scope="module")
def clean(spark):
    tables = {t: seed_table(spark, t) for t in seed_rows()}
    for t in schemas.TABLES:
        tables.setdefault(t, spark.createDataFrame([], schemas.schema(t, "string")))
    return tables


def test_seed_rows_satisfy_every_rule(clean):
    assert quality.check(clean).count() == 0


def found(df):
    return {(r.rule_id, r.key, r.detail) for r in df.collect()}


def test_broken_rows_are_found(spark, clean):
    bad = dict(clean)
    bad["customers"] = clean["customers"].withColumns({
        "email": F.when(F.col("customer_id").isin("C0001", "C0002"), "x").otherwise(F.col("email")),
        "status": F.when(F.col("customer_id") == "C0003", "GONE").otherwise(F.col("status")),
        "phone": F.when(F.col("customer_id") != "C0004", F.col("phone")),
    })
    bad["taxes"] = clean["taxes"].union(clean["taxes"].where("tax_id = 'T0001'")).withColumn(
        "is_active", F.when(F.col("tax_id") == "T0002", 2).otherwise(F.col("is_active")))
    bad["equipments"] = clean["equipments"].withColumn(
        "category_id", F.when(F.col("equipment_id") == "EQ001", "CAT99")
        .when(F.col("equipment_id") != "EQ002", F.col("category_id")))
    bad["inventory"] = clean["inventory"].withColumn(
        "lost_quantity", F.when(F.col("inventory_id") == "IV001", -1)
        .when(F.col("inventory_id") != "IV002", F.col("lost_quantity")))
    payments = [("P1", "DEPOSIT", "I1", "R1"), ("P2", "RENTAL", None, "R1"), ("P3", "REFUND", None, None),
                ("P4", "EXTRA", "I1", None), ("P5", None, None, None), ("P6", "DEPOSIT", None, "R1"),
                ("P7", None, "I1", "R1")]
    bad["payments"] = spark.createDataFrame(
        payments, "payment_id string, payment_type string, invoice_id string, rental_id string")
    assert found(quality.unique(bad | {"payments": clean["payments"]})) == {("unique:customers.email", "x", "2")}
    assert found(quality.primary_keys(bad)) == {("pk:taxes", "T0001", "2")}
    assert found(quality.foreign_keys(bad | {"payments": clean["payments"]})) == {
        ("fk:equipments.category_id", "EQ001", "CAT99")}
    assert found(quality.not_null(bad | {"payments": clean["payments"]})) == {
        ("null:customers.phone", "C0004", "NULL")}
    assert found(quality.enumerations(bad | {"payments": clean["payments"]})) == {
        ("enum:customers.status", "C0003", "GONE")}
    assert found(quality.flags(bad)) == {("flag:taxes.is_active", "T0002", "2")}
    assert found(quality.ranges(bad)) == {("range:inventory.lost_quantity", "IV001", "-1")}
    assert found(quality.payment_references(bad)) == {
        ("reference:payments", "P1", "DEPOSIT"), ("reference:payments", "P2", "RENTAL"),
        ("reference:payments", "P3", "REFUND"),
        ("reference:payments", "P5", "NULL")}  # false without any reference; P7 is unknown and passes
    assert found(quality.bucket_sums(bad)) == {("sum:inventory", "IV001", "2")}


def test_all_families_at_once_equal_each_alone(spark, clean):
    bad = dict(clean)
    bad["inventory"] = clean["inventory"].withColumn("equipment_id", F.lit("EQ999"))
    bad["taxes"] = clean["taxes"].withColumn("tax_id", F.lit(None).cast("string"))
    alone = [found(quality.check(bad, [family])) for family in quality.FAMILIES]
    assert found(quality.check(bad)) == set().union(*alone)
    assert len(found(quality.foreign_keys(bad))) == clean["inventory"].count()
    assert ("pk:taxes", "NULL", str(clean["taxes"].count())) in alone[0]


def test_parts_of_a_key_do_not_run_together(spark, clean):
    pairs = [("A", "B/C"), ("A/B", "C"), (None, "C"), (None, "C"), ("NULL", "C")]
    bad = dict(clean)
    bad["equipment_accessories"] = spark.createDataFrame(pairs, "equipment_id string, accessory_id string")
    assert found(quality.primary_keys(bad)) == {("pk:equipment_accessories", "NULL/C", "2")}
    lost = found(quality.foreign_keys(bad))
    assert {(r, d) for r, _, d in lost} == {
        (f"fk:equipment_accessories.{c}", v) for i, c in enumerate(("equipment_id", "accessory_id"))
        for v in {p[i] for p in pairs} if v}


def test_one_aggregation_serves_all_keys(clean):
    plan = quality.primary_keys(clean)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_key_rules_group_small_rows(spark, clean):
    """nearly every key is a group of its own, so no group carries names or arrays."""
    plan = quality.primary_keys(clean)._jdf.queryExecution().optimizedPlan().toString()
    grouping = next(line for line in plan.splitlines() if "Aggregate [" in line)
    assert "rule_id" not in grouping and "array" not in grouping and "value" not in grouping


def test_null_keys_and_the_text_null_stay_apart(spark, clean):
    bad = dict(clean)
    shape = clean["categories"].schema
    bad["categories"] = spark.createDataFrame([(None, "a"), ("NULL", "b"), ("NULL", "c")], ["category_id", "category_name"]).select(
        *[f.name if f.name in ("category_id", "category_name") else F.lit(None).cast(f.dataType).alias(f.name) for f in shape])
    assert found(quality.primary_keys(bad)) == {("pk:categories", "NULL", "1"), ("pk:categories", "NULL", "2")}
