"""Procedures on small hand-made tables: branches, repeats and all-or-nothing batches."""

import datetime as dt
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import AS_OF
from gearledger.operators import billing, rentals, stock
from gearledger.sources.schemas import schema
from gearledger.sources.seed import seed_table

T = dt.datetime
ASK = "request_id long, rental_id string"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def codes(decision):
    return {int(r.key): (r.source, r.code) for r in decision.rejects.collect()}


def test_create_rental_walks_the_refusals(spark):
    commands = [
        (1, "C0001", "EQ001", 1, 2, 1), (2, "C0001", "EQ001", 1, 2, 1), (3, "C0001", "EQ002", 1, 2, 0),
        (4, "C9999", "EQ002", 1, 2, 1), (5, "C0001", "EQ999", 1, 2, 1), (6, "C0001", "EQ002", 0, 2, None),
        (7, "C0001", "EQ002", 1, 2, None), (8, "C0001", "EQ003", 1, 2, 1), (9, "C0001", "EQ004", 1, 2, 1),
        (10, "C0001", "EQ013", 1, 2, 1), (11, "C0001", "EQ014", 1, None, 1), (12, "C0001", "EQ009", 2, 3, 1),
        (13, "C0001", "EQ002", 1, 1, 1),
    ]
    batch = frame(
        spark,
        [(n, c, "E0001", "S0001", e, q, d, T(2024, 6, 1), T(2024, 6, 5), ok) for n, c, e, q, d, ok in commands],
        "request_id long, customer_id string, employee_id string, shop_id string, equipment_id string,"
        " quantity int, days int, rental_date timestamp_ntz, due_date timestamp_ntz, customer_confirm int")
    accessories = frame(
        spark, [("EQ001", "EQ021", 1), ("EQ001", "EQ005", 1), ("EQ002", "EQ021", 2), ("EQ003", "EQ006", 1),
                ("EQ004", "EQ999", 1)],
        "equipment_id string, accessory_id string, quantity int")
    equipments = seed_table(spark, "equipments").withColumn(
        "status", F.when(F.col("equipment_id") == "EQ013", "DISABLED").otherwise(F.col("status")))
    inventory = seed_table(spark, "inventory")
    created = rentals.create_rentals(
        batch, seed_table(spark, "customers"), equipments, accessories, inventory, AS_OF)
    assert codes(created.decision) == {
        2: ("stock_out", -20011),        # one camera is free, request 1 took it
        3: ("create_rental", -20060), 4: ("create_rental", -20050), 5: ("create_rental", -20050),
        6: ("item_check", -20040),
        8: ("compatibility", -20046),    # E lens on a Z camera
        9: ("compatibility", -20043),    # accessory unknown
        10: ("item_available", -20050),
        11: ("create_rental", -1400),    # no days, so no total for the rental row
        13: ("stock_out", -20011),       # a camera is left, but only no batteries
    }
    made = rentals.rental_rows(created, AS_OF)
    got = {r.request_id: (r.rental_id, r.total_amount, r.deposit_required) for r in made.collect()}
    assert got == {
        1: ("RE001", D(1000000), D(13500000)), 7: ("RE002", D(900000), D("11474596.77")),
        12: ("RE003", D(300000), D(770000))}
    items = rentals.item_rows(created, made).orderBy("rental_item_id").collect()
    assert [(r.rental_item_id, r.rental_id, r.equipment_id, r.quantity, r.subtotal) for r in items] == [
        ("RI001", "RE001", "EQ001", 1, D(1000000)), ("RI002", "RE001", "EQ005", 1, D(0)),
        ("RI003", "RE001", "EQ021", 1, D(0)), ("RI004", "RE002", "EQ002", 1, D(900000)),
        ("RI005", "RE002", "EQ021", 2, D(0)), ("RI006", "RE003", "EQ009", 2, D(300000))]
    after = stock.inventory_after_rent(created.lines, inventory, AS_OF).collect()
    assert all(r.total_quantity == r.available_quantity + r.rented_quantity for r in after)
    assert {r.equipment_id: r.available_quantity for r in after}["EQ021"] == 0


def _rentals(spark, rows):
    return frame(spark, rows, "rental_id string, status string")


def test_deposit_payment_order_of_checks(spark):
    commands = frame(spark, [(n, r, "CASH") for n, r in enumerate(["R1", "R9", "R2", "R3", "R4", "R1"])],
                     ASK + ", payment_method string")
    items = frame(spark, [("R1", "EQ001", 2), ("R1", "EQ021", 5), ("R3", "EQ001", 1), ("R4", "EQ021", 1)],
                  "rental_id string, equipment_id string, quantity int")
    deposits = frame(spark, [("R3",)], "rental_id string")
    decision = billing.deposit_payments(
        commands, _rentals(spark, [(f"R{n}", "CREATED") for n in range(1, 5)]), items,
        seed_table(spark, "equipments"), deposits, AS_OF)
    assert {k: c for k, (_, c) in codes(decision).items()} == {
        1: -20001, 2: -20004, 3: -20002, 4: -20003, 5: -20002}
    payments, held = billing.deposit_rows(decision, AS_OF, last_payment=41)
    assert [(r.payment_id, r.transaction_code, r.amount, r.rental_id) for r in payments.collect()] == [
        ("PY042", "TX00042", D(27000000), "R1")]
    assert [(r.deposit_id, r.payment_id, r.status) for r in held.collect()] == [("DP001", "PY042", "HELD")]


def test_pickup_changes_and_media(spark):
    table = _rentals(spark, [("R1", "CREATED"), ("R2", "CONFIRMED"), ("R3", "BORROWING")])
    commands = frame(spark, list(enumerate(["R1", "R1", "R2", "R3", "R9"])), ASK)
    decision = rentals.confirm_pickups(commands, table)
    assert {k: c for k, (_, c) in codes(decision).items()} == {1: -20001, 3: -20001, 4: -20001}
    items = frame(spark, [(1, "R1"), (2, "R2"), (3, "R3"), (4, "R1")], "rental_item_id long, rental_id string")
    media = rentals.pickup_media(decision, items, AS_OF).collect()
    assert {(r.media_id, r.rental_item_id) for r in media} == {("MD00001", 1), ("MD00002", 2), ("MD00003", 4)}
    changed = rentals.picked_up_rentals(decision, AS_OF).collect()
    assert {(r.rental_id, r.status) for r in changed} == {("R1", "BORROWING"), ("R2", "BORROWING")}


def test_pay_invoice_once(spark):
    invoices = frame(spark, [("I1", "PENDING", "R1", D(10)), ("I2", "PAID", "R2", D(20))],
                     "invoice_id string, status string, rental_id string, final_amount decimal(10,2)")
    commands = frame(spark, [(n, i, "CARD") for n, i in enumerate(["I1", "I2", "I9", "I1"])],
                     "request_id long, invoice_id string, payment_method string")
    decision = billing.pay_invoices(commands, invoices)
    assert sorted(codes(decision)) == [1, 2, 3]
    rows = billing.payment_rows(decision, AS_OF).collect()
    assert [(r.payment_id, r.amount, r.payment_type, r.invoice_id) for r in rows] == [
        ("PM00001", D(10), "RENTAL", "I1")]
    assert [tuple(r) for r in billing.paid_invoices(decision).collect()] == [("I1", "PAID")]


def _fee_tables(spark):
    """R1 1 day late on 100 a day, R2 lost an item, R3 clean, R4 cents."""
    table = frame(
        spark,
        [(f"R{n}", "BORROWING", "PICKUP", T(2024, 6, 1), "C0001", "S0001") for n in range(1, 5)],
        "rental_id string, status string, rental_type string, due_date timestamp_ntz,"
        " customer_id string, shop_id string")
    items = frame(
        spark,
        [(1, "R1", "EQ020", 1, D(100), D(200)), (2, "R2", "EQ020", 1, D(100), D(200)),
         (3, "R3", "EQ020", 1, D(100), D(200)), (4, "R4", "EQ020", 1, D("0.01"), D("0.01"))],
        "rental_item_id long, rental_id string, equipment_id string, quantity int,"
        " price_per_day decimal(10,2), subtotal decimal(10,2)")
    returns = frame(
        spark,
        [(1, 1, T(2024, 6, 2), "GOOD", None), (2, 2, T(2024, 6, 1), "LOST", None),
         (3, 3, T(2024, 5, 30), "GOOD", D(50)), (4, 4, T(2024, 6, 1, 4), "GOOD", None)],
        "return_id long, rental_item_id long, return_date timestamp_ntz, condition_status string,"
        " damage_percent decimal(5,2)")
    return table, items, returns


def test_refund_statuses_use_the_unrounded_fee(spark):
    table, items, returns = _fee_tables(spark)
    deposits = frame(
        spark,
        [("D1", D(500), "HELD", "R1"), ("D2", D(500), "USED", "R2"), ("D3", D(500), "HELD", "R3"),
         ("D4", D(500), "HELD", "R4"), ("D5", D(500), "REFUNDED", "R1")],
        "deposit_id string, deposit_amount decimal(10,2), status string, rental_id string")
    commands = frame(spark, list(enumerate(["R1", "R2", "R3", "R4", "R1", "R9"])), ASK)
    decision = billing.refunds(commands, deposits, table, items, returns, seed_table(spark, "equipments"), AS_OF)
    # The repeated command and the unknown rental are refused; nothing gets lost.
    assert codes(decision) == {4: ("process_refund", -1403), 5: ("process_refund", -20001)}
    assert decision.frame.select("request_id").distinct().count() == 6
    assert {r.deposit_id: (r.refund_amount, r.status) for r in decision.accepted.collect()} == {
        "D1": (D(350), "PARTIAL_REFUND"), "D2": (D(0), "PARTIAL_REFUND"), "D3": (D(500), "REFUNDED"),
        "D4": (D(500), "PARTIAL_REFUND")}  # a fee of 0.0025 rounds away but decides the status


def _invoice_inputs(spark):
    table, items, returns = _fee_tables(spark)
    deposits = frame(spark, [("R3", D(1000))], "rental_id string, deposit_amount decimal(10,2)")
    return (table, items, returns, seed_table(spark, "equipments"), seed_table(spark, "shop_info"),
            seed_table(spark, "customers"), deposits, seed_table(spark, "taxes"))


def test_invoice_amounts_floor_and_refusals(spark):
    table, *rest = _invoice_inputs(spark)
    table = table.withColumn("status", F.when(F.col("rental_id") == "R2", "CREATED").otherwise(F.col("status")))
    commands = frame(spark, list(enumerate(["R1", "R2", "R3", "R9", "R1"])), ASK)
    decision = billing.create_invoices(commands, table, *rest, AS_OF)
    assert codes(decision) == {1: ("create_invoice", -20002), 3: ("create_invoice", -20001)}
    rows = billing.invoice_rows(decision, AS_OF).orderBy("invoice_id").collect()
    assert [(r.invoice_number, r.rental_id, r.late_fee, r.tax_amount, r.total_amount, r.final_amount) for r in rows] == [
        ("INV00001", "R1", D(150), D(35), D(385), D(385)), ("INV00002", "R3", D(0), D(20), D(220), D(0)),
        ("INV00003", "R1", D(150), D(35), D(385), D(385))]
    assert rows[0].payment_due_date == T(2024, 7, 8)
    untaxed = billing.create_invoices(commands, table, *rest, "2020-01-01 00:00:00")
    assert codes(untaxed)[0] == ("create_invoice", -1403)


def test_complete_rental_is_all_or_nothing(spark):
    """Contended return buckets and unpriced invoices against a plain loop."""
    rng = random.Random(11)
    n, equipments = 40, [f"EQ{k:03d}" for k in range(1, 7)]
    table = frame(
        spark,
        [(f"R{k}", rng.choice(["BORROWING", "OVERDUE", "CREATED"]), "NORMAL" if k % 5 == 0 else "PICKUP",
          T(2024, 6, 1), "C0099" if k % 5 == 0 else "C0001", "S0001") for k in range(n)],
        "rental_id string, status string, rental_type string, due_date timestamp_ntz,"
        " customer_id string, shop_id string")
    lines = [(100 * k + j, f"R{k}", rng.choice(equipments), rng.randint(1, 4), D(1), D(1))
             for k in range(n) for j in range(rng.randint(0, 3))]
    items = frame(spark, lines, "rental_item_id long, rental_id string, equipment_id string, quantity int,"
                                " price_per_day decimal(10,2), subtotal decimal(10,2)")
    rented = {e: rng.randint(5, 40) for e in equipments[:-1]}  # the last one has no stock row
    inventory = spark.createDataFrame(
        [(e, q, 0, q, 0, 0, 0, T(2024, 1, 1), e) for e, q in rented.items()], schema("inventory", "string"))
    billed = {"R5", "R10"}
    invoices = frame(spark, [(r, "FINAL") for r in billed], "rental_id string, invoice_type string")
    asked = [f"R{rng.randint(0, n + 2)}" for _ in range(120)]
    _, _, returns = _fee_tables(spark)
    done = rentals.complete_rentals(
        frame(spark, list(enumerate(asked)), ASK), table, items, returns.where("false"),
        seed_table(spark, "equipments"), inventory, seed_table(spark, "shop_info"),
        seed_table(spark, "customers"), frame(spark, [], "rental_id string, deposit_amount decimal(10,2)"),
        invoices, seed_table(spark, "taxes"), AS_OF)
    state = {r.rental_id: (r.status, r.customer_id) for r in table.collect()}
    left, want = dict(rented), {}
    returned = set()
    for request, rental in enumerate(asked):
        if rental not in state:
            want[request] = ("complete_rental", -20001)
            continue
        if state[rental][0] not in ("BORROWING", "OVERDUE") or rental in returned:
            want[request] = ("complete_rental", -20002)
            continue
        need = {}
        for _, r, e, q, _, _ in lines:
            if r == rental:
                need[e] = need.get(e, 0) + q
        if any(e not in left for e in need):
            want[request] = ("stock_in", -1403)
        elif any(q > left[e] for e, q in need.items()):
            want[request] = ("stock_in", -2290)
        elif state[rental][1] == "C0099" and rental not in billed:
            want[request] = ("shipping_fee", -20023)
        else:
            returned.add(rental)
            for e, q in need.items():
                left[e] -= q
    assert codes(done.decision) == want
    assert {r.equipment_id: r.rented_quantity for r in done.inventory.collect()} == left
    assert all(r.total_quantity == r.available_quantity + r.rented_quantity for r in done.inventory.collect())


def test_null_quantities_and_conditions(spark):
    inventory = seed_table(spark, "inventory").withColumn("rented_quantity", F.lit(5))
    asked = frame(spark, [(1, 1, "EQ001", None), (2, 2, "EQ999", None), (3, 3, "EQ001", 0), (4, 4, "EQ001", 1)],
                  "request_id long, seq long, equipment_id string, quantity int")
    assert codes(stock.rent_out(asked, inventory)) == {
        1: ("stock_out", -1407), 2: ("stock_out", -1403), 3: ("stock_out", -20010)}
    items = frame(spark, [("I1", "EQ001", 5)], "rental_item_id string, equipment_id string, quantity int")
    back = frame(spark, [(1, 1, "I1", None), (2, 2, "I1", "GOOD"), (3, 3, "I1", "GOOD"), (4, 4, "I1", "LOOSE")],
                 "request_id long, seq long, rental_item_id string, condition_status string")
    decision = stock.take_back(back, items, inventory)
    # Without a condition nothing moves, so the next return still finds all units out.
    assert codes(decision) == {3: ("stock_in", -2290), 4: ("stock_in", -20020)}
    only = stock.take_back(back.where("request_id = 1"), items, inventory).accepted
    after = stock.inventory_after_return(only, inventory, AS_OF)
    kept = ("equipment_id", "available_quantity", "rented_quantity", "last_updated")
    assert set(after.select(*kept).collect()) == set(inventory.select(*kept).collect())


def test_items_follow_their_rentals(spark):
    from gearledger.operators.rejects import Decision, no_refusal, refuse

    frame_of = frame(spark, [(1, "R1"), (2, "R2")], ASK).withColumn(
        "refusal", F.when(F.col("rental_id") == "R2", refuse("confirm_pickup", -20001)).otherwise(no_refusal()))
    items = frame(spark, [("I1", "R1", "LOST"), ("I2", "R2", "LOST"), ("I3", "R3", None)],
                  "rental_item_id string, rental_id string, item_status string")
    decision = Decision(frame_of, "request_id")
    status = lambda df: {r.rental_item_id: r.item_status for r in df.collect()}
    assert status(rentals.picked_up_items(decision, items)) == {"I1": "BORROWING", "I2": "LOST", "I3": None}
    assert status(rentals.completed_items(decision, items)) == {"I1": "RETURNED", "I2": "LOST", "I3": None}
