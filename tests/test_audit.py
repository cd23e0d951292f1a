"""Audit rows, guards, status recompute, generated codes and timelines."""

import datetime as dt
import random

from conftest import AS_OF
from gearledger.operators import audit, settlement

T = dt.datetime


def test_audit_rows_and_guard(spark):
    changes = spark.createDataFrame(
        [("I", "C1", "ann"), ("U", "C2", None), ("D", "C3", "cy"), ("D", "C4", "di")],
        "op string, record_id string, label string")
    rentals = spark.createDataFrame([("C3",), ("C3",), ("C1",)], "customer_id string")
    decision = audit.audit(changes, "CUSTOMERS", "customer", AS_OF,
                           [(rentals, "customer_id", ("customer_delete", -20060))])
    log = {r.record_id: (r.action, r.description) for r in decision.accepted.collect()}
    assert log == {"C1": ("INSERT", "Inserted customer ann"), "C2": ("UPDATE", "Updated customer "),
                   "C4": ("DELETE", "Deleted customer di")}
    assert [(r.key, r.code, r.message) for r in decision.rejects.collect()] == [
        ("C3", -20060, "Cannot delete customer; linked rentals exist.")]


def test_status_priority_and_log(spark):
    items = spark.createDataFrame(
        [(1, "E1", "BORROWING"), (2, "E1", "LOST"), (3, "E2", "DAMAGED"), (4, "E2", "RETURNED"),
         (5, "E3", "RETURNED"), (6, "E4", "LOST")],
        "rental_item_id int, equipment_id string, item_status string")
    equipments = spark.createDataFrame([(f"E{n}", "AVAILABLE") for n in range(1, 6)],
                                       "equipment_id string, status string")
    changes = spark.createDataFrame(
        [(2, "E1", "BORROWING", "LOST"), (3, "E2", "BORROWING", "DAMAGED"), (5, "E3", None, "RETURNED")],
        "rental_item_id int, equipment_id string, old_item_status string, new_item_status string")
    got = {r.equipment_id: r.new_status for r in audit.status_changes(changes, items, equipments).collect()}
    assert got == {"E1": "MAINTENANCE", "E2": "DISABLED", "E3": "AVAILABLE"}
    texts = {r.record_id: r.description for r in audit.status_log(changes, items, AS_OF).collect()}
    assert texts["E2"] == ("Updated equipment status to DISABLED due to rental item 3"
                           " changed from BORROWING to DAMAGED")
    assert texts["E3"].endswith("changed from  to RETURNED")


def test_missing_codes_are_numbered_in_order(spark):
    rows = [(n * 2**18, None if n % 3 else f"OLD{n}", None) for n in range(12)]
    df = spark.createDataFrame(rows, "arrival long, a string, b string")
    got = sorted(audit.fill_codes(df, "arrival", {"a": ("RE", 3), "b": ("RC", 5)}, start=998).collect())
    missing = [r.a for r in got if not r.a.startswith("OLD")]
    assert missing == ["RE998", "RE999", *[f"RE{n}" for n in range(1000, 1006)]]
    assert [r.b for r in got] == [f"RC{998 + n:05d}" for n in range(12)]


def test_overlaps_are_counted_without_pairs(spark):
    rng = random.Random(4)
    rentals, items = [], []
    for n in range(150):
        start = T(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 400))
        rentals.append((n, rng.choice(["BORROWING"] * 4 + ["RETURNED"]), start,
                        rng.choice([start, None]), start + dt.timedelta(hours=rng.randint(-2, 60))))
        items += [(n, rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(1, 3))]
    got = settlement.overlapping_rentals(
        spark.createDataFrame(rentals, "rental_id int, status string, rental_date timestamp_ntz,"
                                       " start_date timestamp_ntz, due_date timestamp_ntz"),
        spark.createDataFrame(items, "rental_id int, equipment_id int"))
    active = {r[0]: (r[3] or r[2], r[4]) for r in rentals if r[1] == "BORROWING" and r[2] < r[4]}
    held = {(e, r) for r, e in items if r in active}
    want = {}
    for e, r in held:
        (a, b) = active[r]
        others = sum(1 for f, s in held if f == e and s != r and active[s][0] < b and a < active[s][1])
        if others:
            want[e, r] = others
    assert {(r.equipment_id, r.rental_id): r.overlaps for r in got.collect()} == want
