"""Compatibility and item validation: every branch, and the item rule against a plain loop."""

import random
from decimal import Decimal as D

from gearledger.operators import checks
from gearledger.sources.seed import seed_table

EQ = ("equipment_id long, equipment_type string, status string, category_id string,"
      " mount_type string")
ITEM = ("rental_item_id long, rental_id long, equipment_id long, quantity int, days int,"
        " price_per_day decimal(10,2), item_status string")


def test_seed_pairs(spark):
    pairs = [("EQ001", "EQ005", None), ("EQ001", "EQ006", -20046), ("EQ001", "EQ009", None),
             ("EQ001", "EQ021", None), ("EQ005", "EQ001", -20044), ("EQ999", "EQ001", -20042),
             ("EQ001", "EQ999", -20043), ("EQ999", "EQ998", -20042)]
    df = spark.createDataFrame(
        [(n, m, x) for n, (m, x, _) in enumerate(pairs)],
        "request_id int, main_equipment_id string, extra_equipment_id string")
    rejects = checks.check_compatibility(df, seed_table(spark, "equipments")).rejects.collect()
    assert {int(r.key): r.code for r in rejects} == {
        n: c for n, (_, _, c) in enumerate(pairs) if c}
    assert all(r.message for r in rejects)


EQUIPMENT = {
    1: ("MAIN", "AVAILABLE", "CAT01", "RF"), 2: ("MAIN", "AVAILABLE", "CAT01", None),
    3: ("MAIN", "AVAILABLE", None, "RF"), 4: ("ACCESSORY", "AVAILABLE", "CAT02", "RF"),
    5: ("ACCESSORY", "AVAILABLE", "CAT02", "E"), 6: ("ACCESSORY", "AVAILABLE", "CAT02", None),
    7: ("ACCESSORY", "AVAILABLE", "CAT03", "E"), 8: ("ACCESSORY", "AVAILABLE", "CAT03", None),
    9: ("ACCESSORY", "AVAILABLE", "CAT06", None), 10: ("MAIN", "MAINTENANCE", "CAT01", "RF"),
    11: ("MAIN", "AVAILABLE", "CAT04", "X"),
}


def pair_code(main, extra):
    m, x = EQUIPMENT.get(main), EQUIPMENT.get(extra)
    if m is None:
        return -20042
    if x is None:
        return -20043
    if m[2] is not None and m[2] != "CAT01":
        return -20044
    if x[2] == "CAT02" and (m[3] is None or x[3] is None):
        return -20045
    if x[2] == "CAT02" and m[3] != x[3]:
        return -20046
    if x[2] == "CAT03" and m[3] and x[3] and m[3] != x[3]:
        return -20047
    return None


def table(spark):
    return spark.createDataFrame([(k, *v) for k, v in EQUIPMENT.items()], EQ)


def test_all_pairs_against_plain_rules(spark):
    pairs = [(m, x) for m in [*EQUIPMENT, 99] for x in [*EQUIPMENT, 98]]
    df = spark.createDataFrame(
        [(n, m, x) for n, (m, x) in enumerate(pairs)],
        "request_id int, main_equipment_id long, extra_equipment_id long")
    got = {int(r.key): r.code for r in checks.check_compatibility(df, table(spark)).rejects.collect()}
    assert got == {n: c for n, p in enumerate(pairs) if (c := pair_code(*p))}


def test_items_against_one_by_one_insert(spark):
    rng = random.Random(9)
    existing, new = [], []
    for n in range(600):
        item = (n, rng.randint(1, 90), rng.choice([*EQUIPMENT, 99]),
                rng.choice([1, 2, 3, 4, 0, None]), rng.choice([1, 2, 3, 4, 5, None]),
                rng.choice([D(1), D(2), D(3), None]), rng.choice(["BORROWING", "LOST", "WRONG", None]))
        if n < 60 and item[2] != 99:
            existing.append((n, item[1], item[2], 1, 1, D(1), "BORROWING"))
        else:
            new.append(item)
    shelf: dict[int, list] = {}
    for item in existing:
        shelf.setdefault(item[1], []).append((item[0], item[2]))
    want = {}
    for n, rental, eq, quantity, days, price, status in new:
        code = None
        if eq not in EQUIPMENT:
            code = -1403
        else:
            if EQUIPMENT[eq][0] == "ACCESSORY":
                others = [e for _, e in sorted(shelf.get(rental, [])) if e != eq]
                code = pair_code(others[0], eq) if others else None
            if code is None and (quantity is None or quantity <= 0):
                code = -20040
            if code is None and (days is None or price is None):
                code = -20041
            if code is None and status == "WRONG":
                code = -20042
            if code is None and EQUIPMENT[eq][1] != "AVAILABLE":
                code = -20050
        want[n] = code
        if code is None:
            shelf.setdefault(rental, []).append((n, eq))
    decision = checks.check_items(
        spark.createDataFrame(new, ITEM), spark.createDataFrame(existing, ITEM), table(spark))
    got = {int(r.key): r.code for r in decision.rejects.collect()}
    assert got == {n: c for n, c in want.items() if c}
    accepted = decision.accepted.collect()
    assert {r.rental_item_id for r in accepted} == {n for n, c in want.items() if not c}
    assert all(r.subtotal == r.quantity * r.days * r.price_per_day for r in accepted)


def test_available(spark):
    items = spark.createDataFrame([(1, 1), (2, 10), (3, 99)], "rental_item_id long, equipment_id long")
    got = {int(r.key): r.code for r in checks.check_available(items, table(spark)).rejects.collect()}
    assert got == {2: -20050, 3: -1403}


def test_lens_counts(spark):
    got = {r.equipment_id: r.lens_count for r in checks.compatible_lens_counts(table(spark)).collect()}
    assert got == {1: 1, 2: 0, 10: 1}
