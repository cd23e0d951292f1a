"""Allocation against serving the requests one after another."""

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gearledger.operators import stock
from gearledger.operators.components import components

LINES = "request_id long, seq long, equipment_id long, quantity int"


def sequential(requests, capacity, doomed=()):
    left, served = dict(capacity), {}
    for request, lines in requests:
        need = {}
        for equipment, units in lines:
            need[equipment] = need.get(equipment, 0) + units
        fits = all(left.get(e, 0) >= u for e, u in need.items())
        served[request] = fits
        if fits and request not in doomed:
            for e, u in need.items():
                left[e] -= u
    return served


def run(spark, requests, capacity, stream_lines, doomed=(), **options):
    rows = {True: [], False: []}
    for seq, (request, lines) in enumerate(requests):
        for equipment, units in lines:
            rows[request in doomed].append((request, seq, equipment, units))
    levels = spark.createDataFrame(list(capacity.items()), "equipment_id long, capacity int")
    got = stock.allocate(
        spark.createDataFrame(rows[False], LINES),
        levels,
        probes=spark.createDataFrame(rows[True], LINES) if doomed else None,
        stream_lines=stream_lines,
        **options,
    )
    answers = [(r.request_id, r.served) for r in got.collect()]
    assert len(answers) == len(dict(answers))
    return dict(answers)


requests_strategy = st.lists(
    st.lists(st.tuples(st.integers(1, 4), st.integers(1, 9)), min_size=1, max_size=3),
    min_size=1, max_size=25,
)


@settings(max_examples=4, deadline=None)
@given(lines=requests_strategy, stocks=st.lists(st.integers(0, 30), min_size=3, max_size=4),
       stream=st.sampled_from([0, 10**6]), head=st.sampled_from([7, 10**5]))
def test_allocation_equals_sequential(spark, lines, stocks, stream, head):
    requests = list(enumerate(lines, start=100))
    capacity = dict(enumerate(stocks, start=1))
    assert run(spark, requests, capacity, stream, head_lines=head) == sequential(requests, capacity)


def chain(n):
    """Every request shares an equipment with the one before it and the one after it."""
    return [(i, [(i % 25 + 1, 1), ((i + 1) % 25 + 1, 1)]) for i in range(n)]


@pytest.mark.parametrize("length, head, most", [(2000, stock.HEAD_LINES, 1), (24, 12, 4)])
def test_a_chain_ends_in_few_rounds(spark, monkeypatch, length, head, most):
    rounds = []
    path = stock.new_path
    monkeypatch.setattr(stock, "new_path", lambda *a: rounds.append(path(*a)) or rounds[-1])
    capacity = {e: 1 for e in range(1, 26)}
    assert run(spark, chain(length), capacity, 0, head_lines=head) == sequential(chain(length), capacity)
    assert len(list(Path(rounds[0]).glob("round=*"))) <= most


def test_many_lines_of_one_equipment_at_once(spark):
    rng = random.Random(9)
    requests = [(n, [(rng.randint(1, 3), rng.randint(1, 400))]) for n in range(3000)]
    capacity = {1: 40_000, 2: 3, 3: 0}
    assert run(spark, requests, capacity, 10**6) == sequential(requests, capacity)


@pytest.mark.parametrize("stream_lines", [0, 10**6])
def test_popular_equipment(spark, stream_lines):
    """A third of all requests want one equipment; by rounds and by streaming."""
    rng = random.Random(5)
    requests = [
        (n, [(1 if rng.random() < 0.34 else rng.randint(2, 40), rng.randint(1, 50))])
        for n in range(600)
    ]
    capacity = {e: rng.randint(0, 300) for e in range(1, 41)}
    assert run(spark, requests, capacity, stream_lines) == sequential(requests, capacity)


def test_worst_case_rounds_stay_exact(spark):
    """Small and just-too-large requests alternate: one decision per round and kind."""
    requests = []
    for n in range(12):
        requests += [(2 * n, [(1, 1)]), (2 * n + 1, [(1, 12 - n)])]
    assert run(spark, requests, {1: 12}, 0) == sequential(requests, {1: 12})


def test_probes_take_nothing_but_learn_the_answer(spark):
    rng = random.Random(6)
    requests = [
        (n, [(rng.randint(1, 3), rng.randint(1, 6)), (rng.randint(1, 3), 1)]) for n in range(60)
    ]
    doomed = set(range(3, 60, 7))
    capacity = {1: 60, 2: 40, 3: 25}
    assert run(spark, requests, capacity, 10**6, doomed) == sequential(requests, capacity, doomed)


def _inventory(spark, rows):
    return spark.createDataFrame(
        rows,
        "equipment_id long, total_quantity int, available_quantity int, rented_quantity int,"
        " maintenance_quantity int, damaged_quantity int, lost_quantity int,"
        " last_updated timestamp_ntz",
    )


def test_rent_out_codes_and_buckets(spark):
    inventory = _inventory(spark, [(1, 5, 5, 0, 0, 0, 0, None), (2, 3, None, None, 0, 0, 0, None)])
    requests = spark.createDataFrame(
        [(1, 1, 1, 3), (2, 2, 1, 3), (3, 3, 1, 2), (4, 4, 1, 0), (5, 5, 9, 1), (6, 6, 2, 1),
         (7, 7, 1, None)],
        LINES,
    )
    decision = stock.rent_out(requests, inventory)
    codes = {r.key: r.code for r in decision.rejects.collect()}
    assert codes == {"2": -20011, "4": -20010, "5": -1403, "6": -20011, "7": -1407}
    after = stock.inventory_after_rent(decision.accepted, inventory, "2024-07-01 00:00:00")
    assert {r.equipment_id: (r.available_quantity, r.rented_quantity) for r in after.collect()} == {
        1: (0, 5), 2: (None, 0)}


def test_take_back_keeps_bucket_sums(spark):
    inventory = _inventory(spark, [(1, 10, 2, 8, 0, 0, 0, None)])
    items = spark.createDataFrame(
        [(n, 1, q) for n, q in enumerate([3, 4, 2, 1, 1], start=1)],
        "rental_item_id long, equipment_id long, quantity int",
    )
    commands = spark.createDataFrame(
        [(1, 1, 1, "GOOD"), (2, 2, 2, "DAMAGED"), (3, 3, 3, "GOOD"), (4, 4, 4, "LOST"),
         (5, 5, 5, "BROKEN"), (6, 6, 99, "GOOD")],
        "request_id long, seq long, rental_item_id long, condition_status string",
    )
    decision = stock.take_back(commands, items, inventory)
    codes = {r.key: r.code for r in decision.rejects.collect()}
    assert codes == {"3": -2290, "5": -20020, "6": -1403}
    row = stock.inventory_after_return(decision.accepted, inventory, "2024-07-01 00:00:00").first()
    assert (row.available_quantity, row.rented_quantity, row.damaged_quantity, row.lost_quantity) == (5, 0, 4, 1)
    assert row.total_quantity == 5 + 0 + 4 + 1


def test_components_of_a_long_path_and_a_star(spark):
    """Paths, stars and lone links; the number of rounds does not follow the path's length."""
    rng = random.Random(2)
    order = list(range(1, 401))
    rng.shuffle(order)
    links = list(zip(order, order[1:])) + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5001), (6000, 6000)]
    rng.shuffle(links)
    frame = spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in links], "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    want = dict.fromkeys(range(1, 401), 1) | dict.fromkeys(range(1000, 1200), 1000) | {5000: 5000, 5001: 5000, 6000: 6000}
    assert got == want


def test_chains_are_served_side_by_side(spark):
    """Independent chains of requests are components of their own, each served in one group."""
    rng = random.Random(11)
    requests = []
    for n in range(4000):
        base = 100 * rng.randint(0, 7)
        first = rng.randint(1, 30)
        requests.append((n, [(base + first, rng.randint(1, 4)), (base + first % 30 + 1, rng.randint(1, 4))]))
    capacity = {100 * b + e: rng.randint(0, 60) for b in range(8) for e in range(1, 31)}
    assert run(spark, requests, capacity, 10**6) == sequential(requests, capacity)
    lines = spark.createDataFrame([(r, r, e, u, capacity[e]) for r, ls in requests for e, u in ls],
                                  "request_id long, seq long, equipment_id long, quantity long, capacity long")
    parts = stock._with_components(lines).groupBy("component").agg({"equipment_id": "count"}).collect()
    assert sorted(r.component for r in parts) == [100 * b + 1 for b in range(8)]


@pytest.mark.parametrize("rows, window", [(7, 3), (64, 10), (5000, 4096)])
def test_windows_and_batches_change_nothing(rows, window):
    """Requests cut by batches and windows, components one after another in one task."""
    import pandas as pd

    rng = random.Random(rows)
    lines, want = [], {}
    for component in range(3):
        left = {e: rng.randint(0, 40) for e in range(5)}
        start = dict(left)
        for n in range(60):
            asked = {e: rng.randint(1, 9) for e in rng.sample(range(5), rng.randint(1, 3))}
            request = 100 * component + n
            want[request] = all(left[e] >= u for e, u in asked.items())
            for e, u in asked.items():
                lines.append((component, n, request, 10 * component + e, u, start[e]))
                left[e] -= u if want[request] else 0
    frame = pd.DataFrame(lines, columns=["component", "seq", "request_id", "equipment_id", "quantity", "capacity"])
    batches = [frame.iloc[a : a + rows] for a in range(0, len(frame), rows)]
    told = pd.concat(stock._in_order(window)(iter(batches)))
    assert dict(zip(told["request_id"], told["served"])) == want
