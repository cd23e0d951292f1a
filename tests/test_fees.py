"""Values, deposits and fees: golden rows and every branch."""

import datetime as dt
from decimal import Decimal as D
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from gearledger.functions import columns as C
from gearledger.functions import sqlfuncs
from gearledger.operators import billing, fees
from gearledger.sources.seed import seed_table

T = dt.datetime


def test_literal_value(spark):
    row = spark.range(1).select(
        C.equipment_value(
            C.dec("50000000", 10, 2), C.dec("0.10", 5, 2), C.clock("2022-01-01 00:00:00"),
            C.clock(AS_OF),
        ).alias("v")
    ).first()
    assert row.v == D("37500000.00")


GOLDEN = {
    "EQ001": ("45000000.00", "13500000.00"), "EQ002": ("38248655.91", "11474596.77"),
    "EQ003": ("38454301.08", "11536290.32"), "EQ004": ("26072903.23", "6518225.81"),
    "EQ008": ("14925806.45", "2985161.29"), "EQ009": ("3850000.00", "385000.00"),
    "EQ020": ("410000.00", "41000.00"), "EQ021": ("750000.00", "0.00"),
}


def test_seed_values_and_deposits(spark):
    equipments = seed_table(spark, "equipments")
    both = fees.equipment_values(equipments, AS_OF).join(
        fees.equipment_deposits(equipments, AS_OF), "equipment_id"
    )
    got = {r.equipment_id: (str(r.equipment_value), str(r.deposit)) for r in both.collect()}
    assert {k: got[k] for k in GOLDEN} == GOLDEN
    assert len(got) == 22


def _cents(top: Fraction) -> D:
    return D(int(top * 100 + Fraction(1, 2))) / 100 if top > 0 else D("0.00")


def test_value_rounds_exactly(spark):
    """Half cents and partial months against exact fractions; SQL function agrees."""
    rows = []
    for n in range(400):
        price = D(90000 + 37 * n) / 100
        rate = D(n % 30) / 100
        bought = T(2010, 1, 1) + dt.timedelta(days=13 * n)
        rows.append((n, price, rate, bought))
    rows += [(900, D("900.30"), D("0.10"), T(2024, 5, 1)), (901, D("5"), D("0.50"), T(2025, 1, 1))]
    df = spark.createDataFrame(
        rows, "id int, price decimal(10,2), rate decimal(5,2), bought timestamp_ntz"
    )
    name = sqlfuncs.register(spark)
    got = df.select(
        "id",
        C.equipment_value(F.col("price"), F.col("rate"), F.col("bought"), C.clock(AS_OF)).alias("v"),
        F.expr(f"{name}(price, rate, bought, TIMESTAMP_NTZ '{AS_OF}')").alias("s"),
    ).collect()
    for (n, price, rate, bought), row in zip(rows, sorted(got, key=lambda r: r.id)):
        months = (2024 - bought.year) * 12 + 7 - bought.month
        years = (months + Fraction(1 - bought.day, 31)) / 12
        want = _cents(Fraction(price) - Fraction(price) * Fraction(rate) * years)
        assert row.id == n and row.v == row.s == want, (price, rate, bought)
    assert row.v > D("5")  # a future purchase is worth more than its price


def test_deposit_branches(spark):
    df = spark.createDataFrame(
        [(1, D(100), D(0), T(2024, 7, 1), None), (2, D(100), D(0), T(2024, 7, 1), D(0)),
         (3, D("0.05"), D(0), T(2024, 7, 1), D("0.30")), (4, D(100), D(1), T(2010, 7, 1), D("0.30"))],
        "equipment_id int, purchase_price decimal(10,2), depreciation_rate decimal(5,2),"
        " purchase_date timestamp_ntz, deposit_rate decimal(5,2)",
    )
    got = {r.equipment_id: r.deposit for r in fees.equipment_deposits(df, AS_OF).collect()}
    assert got == {1: D(0), 2: D(0), 3: D("0.02"), 4: D(0)}


def _rentals(spark, rows):
    return spark.createDataFrame(rows, "rental_id int, due_date timestamp_ntz")


def _items(spark, rows):
    return spark.createDataFrame(
        rows, "rental_item_id int, rental_id int, equipment_id int, quantity int,"
              " price_per_day decimal(10,2), subtotal decimal(10,2)")


RETURNS = ("return_id int, rental_item_id int, return_date timestamp_ntz, condition_status string,"
           " damage_percent decimal(5,2)")


def test_late_fee_branches(spark):
    due = T(2024, 6, 1, 12)
    rentals = _rentals(spark, [(n, due) for n in range(1, 6)])
    items = _items(spark, [
        (1, 1, 1, 2, D("10.00"), D(0)), (2, 1, 1, 1, D("5.00"), D(0)),  # two items, one late
        (3, 2, 1, 1, D(10), D(0)),   # not returned
        (4, 3, 1, 1, D(10), D(0)),   # exactly on time
        (5, 4, 1, 1, D(10), D(0)),   # early
    ])
    returns = spark.createDataFrame(
        [(1, 1, T(2024, 6, 2, 18), "GOOD", None), (2, 2, T(2024, 5, 30), "GOOD", None),
         (4, 4, due, "GOOD", None), (5, 5, T(2024, 5, 1), "GOOD", None)], RETURNS)
    got = {r.rental_id: r.late_fee for r in fees.late_fees(rentals, items, returns).collect()}
    assert got == {1: D("46.875"), 2: 0, 3: 0, 4: 0, 5: 0}  # 1.25 days * 25 * 1.5


def test_damage_fee_branches(spark):
    equipments = spark.createDataFrame(
        [(1, D("100.00"), D("0.00"), T(2020, 1, 1))],
        "equipment_id int, purchase_price decimal(10,2), depreciation_rate decimal(5,2),"
        " purchase_date timestamp_ntz")
    items = _items(spark, [(1, 1, 1, 3, D(1), D(0)), (2, 1, 9, 1, D(1), D(0))])
    cases = [("GOOD", 50), ("LOST", 0), ("LOST", None), ("DAMAGED", 0), ("DAMAGED", None),
             ("DAMAGED", "33.33"), ("BROKEN", "33.33")]
    rows = [(n, 1, T(2024, 1, 1), c, None if p is None else D(p)) for n, (c, p) in enumerate(cases)]
    rows += [(70, 2, T(2024, 1, 1), "LOST", None), (71, 99, T(2024, 1, 1), "LOST", None)]
    got = {r.return_id: r.damage_fee for r in fees.damage_fees(
        spark.createDataFrame(rows, RETURNS), items, equipments, AS_OF).collect()}
    assert got == {0: 0, 1: 300, 2: 300, 3: 0, 4: 0, 5: D("99.99"), 6: D("99.99"), 70: 0, 71: 0}


def test_invoice_total_branches(spark):
    invoices = spark.createDataFrame(
        [(1, D("10.05"), None, D("1.00"), None, "T0001", D(2)), (2, D(10), None, None, None, "T9", None),
         (3, D(10), D(1), None, None, "T0001", D(500))],
        "invoice_id int, rental_amount decimal(10,2), late_fee decimal(10,2), damage_fee decimal(10,2),"
        " shipping_fee decimal(10,2), tax_id string, deposit_used decimal(10,2)",
    ).withColumn("final_amount", F.lit(None).cast("decimal(10,2)"))
    got = {r.invoice_id: r.calculated_final
           for r in fees.invoice_totals(invoices, seed_table(spark, "taxes")).collect()}
    assert got == {1: D("10.16"), 2: 0, 3: 0}  # 11.05 + 1.11 tax (1.105 up) - 2


def test_seed_distances_and_fees(spark):
    rentals = seed_table(spark, "customers").select(
        F.col("customer_id").alias("rental_id"), "customer_id", F.lit("S0001").alias("shop_id"),
        F.lit("NORMAL").alias("rental_type"))
    got = {r.rental_id: (str(r.distance_km), int(r.shipping_fee)) for r in fees.shipping_fees(
        rentals, seed_table(spark, "shop_info"), seed_table(spark, "customers")).frame.collect()}
    assert got == {
        "C0001": ("6.95", 50000), "C0002": ("11.18", 70000), "C0003": ("6.05", 50000),
        "C0004": ("8.56", 50000), "C0005": ("7.11", 50000), "C0006": ("7.88", 50000),
        "C0007": ("12.46", 70000), "C0008": ("10.67", 70000), "C0009": ("6.28", 50000),
        "C0010": ("13.47", 70000)}


@pytest.mark.parametrize("km,fee", [
    ("4.99", 20000), ("5.00", 50000), ("9.99", 50000), ("10.00", 70000), ("20.00", 70000),
    ("20.01", None)])
def test_distance_bands(spark, km, fee):
    got = spark.range(1).select(C.distance_fee(C.dec(km, 10, 2)).alias("f")).first().f
    assert got == (None if fee is None else D(fee))


def test_shipping_refusals_in_order(spark):
    shops = spark.createDataFrame(
        [(1, D("10.8"), D("106.6")), (2, None, D("106.6"))],
        "shop_id int, latitude decimal(9,6), longitude decimal(9,6)")
    customers = spark.createDataFrame(
        [(1, D("10.8"), D("106.6")), (2, D("10.8"), None), (3, D("12"), D("106.6"))],
        "customer_id int, latitude decimal(9,6), longitude decimal(9,6)")
    cases = [("NORMAL", 9, 1, -20023), ("PICKUP", 1, 9, -20023), ("PICKUP", 2, 2, None),
             ("NORMAL", 2, 2, -20022), ("RETURN", 1, 2, -20020), ("return", 1, 1, None),
             ("NORMAL", 1, 3, -20021), ("RETURN", 1, 3, None), ("NORMAL", 1, 1, None),
             ("pickup", 1, 1, None)]
    rows = [(n, kind, shop, customer) for n, (kind, shop, customer, _) in enumerate(cases)]
    decision = fees.shipping_fees(
        spark.createDataFrame(rows, "rental_id int, rental_type string, shop_id int, customer_id int"),
        shops, customers)
    codes = {int(r.key): r.code for r in decision.rejects.collect()}
    assert codes == {n: c[3] for n, c in enumerate(cases) if c[3]}
    paid = {r.rental_id: int(r.shipping_fee) for r in decision.accepted.collect()}
    assert paid == {2: 0, 5: 0, 7: 0, 8: 20000, 9: 0}  # same place: 0 km, not NaN


@pytest.mark.parametrize("as_of,tax", [
    (AS_OF, "T0001"), ("2023-12-31 00:00:00", "T0002"), ("2023-12-31 12:00:00", None),
    ("2022-06-01 00:00:00", None), ("2024-01-01 00:00:00", "T0001")])
def test_tax_in_force(spark, as_of, tax):
    row = spark.range(1).select(billing.valid_tax(seed_table(spark, "taxes"), as_of).alias("t")).first()
    assert (row.t.tax_id if row.t else None) == tax


def test_code_text_never_cuts(spark):
    df = spark.createDataFrame([(7,), (1000,), (123456,)], "n long")
    assert [r[0] for r in df.select(C.code_text("RE", F.col("n"), 3)).collect()] == [
        "RE007", "RE1000", "RE123456"]


def test_large_amounts_do_not_stop_the_job(spark):
    """A line or deposit with too many digits is a refusal, not an exception."""
    df = spark.createDataFrame([(99999, 99999, D("99999999.99")), (1, 2, D("3.00"))],
                               "q int, d int, p decimal(10,2)")
    total = C.line_total(F.col("q"), F.col("d"), F.col("p"))
    got = df.select(total.alias("t"), C.too_large(total).alias("over")).collect()
    assert [(str(r.t), r.over) for r in got] == [(str(D(99999) * 99999 * D("99999999.99")), True), ("6.00", False)]
