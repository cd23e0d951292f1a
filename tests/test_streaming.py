"""Streams over several files and batches equal the batch operators."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from gearledger.operators import audit
from gearledger.streaming import jobs, keyed


@pytest.fixture
def changes(spark, tmp_path):
    """Item changes in four files: insert, update, delete, late insert."""
    rows = [
        ("I", 1, "R1", None, D("10.00")), ("I", 2, "R1", None, D("5.50")), ("I", 3, "R2", None, D("7.00")),
        ("U", 2, "R1", D("5.50"), D("6.00")), ("D", 3, "R2", D("7.00"), None), ("I", 4, "R3", None, D("1.00")),
        ("U", 1, "R1", D("10.00"), D("0.25")), ("I", 5, "R2", None, D("3.00")),
    ]
    ddl = ("op string, record_id long, rental_id string, old_subtotal decimal(10,2),"
           " new_subtotal decimal(10,2)")
    path = str(tmp_path / "feed")
    for n in range(0, len(rows), 2):
        spark.createDataFrame(rows[n:n + 2], ddl).withColumn(
            "change_time", F.lit(AS_OF).cast("timestamp_ntz")
        ).withColumn("label", F.col("record_id")).coalesce(1).write.mode("append").parquet(path)
    return path


def test_totals_over_many_batches(spark, changes):
    feed = jobs.file_stream(spark, changes, files_per_trigger=1)
    got = {r.rental_id: r.total_amount for r in jobs.run_totals(feed).collect()}
    assert got == {"R1": D("6.25"), "R2": D("3.00"), "R3": D("1.00")}


def test_audit_stream_equals_batch(spark, changes):
    feed = jobs.file_stream(spark, changes, files_per_trigger=1)
    streamed = jobs.run_audit(feed, "RENTAL_ITEMS", "rental item")
    batch = audit.audit(spark.read.parquet(changes), "RENTAL_ITEMS", "rental item", AS_OF).accepted
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert streamed.count() == 8


def test_streamed_totals_equal_recomputed_totals(spark, changes):
    """The running total equals the total of the items left at the end."""
    last = {}
    for r in spark.read.parquet(changes).collect():
        last.setdefault(r.record_id, []).append(r)
    items = []
    for rows in last.values():
        latest = min(rows, key=lambda r: "DUI".index(r.op))
        if latest.op != "D":
            items.append((latest.rental_id, latest.new_subtotal))
    table = spark.createDataFrame(items, "rental_id string, subtotal decimal(10,2)")
    rentals = spark.createDataFrame([("R1",), ("R2",), ("R3",)], "rental_id string")
    batch = {r.rental_id: r.total_amount for r in audit.rental_totals(rentals, table).collect()}
    streamed = {r.rental_id: r.total_amount
                for r in jobs.run_totals(jobs.file_stream(spark, changes, 2)).collect()}
    assert streamed == batch


def test_a_feed_without_files_gives_no_rows(spark, changes, tmp_path):
    empty = tmp_path / "nothing"
    empty.mkdir()
    feed = spark.readStream.schema(spark.read.parquet(changes).schema).parquet(str(empty))
    assert jobs.run_totals(feed).count() == 0
    log = jobs.run_audit(feed, "RENTAL_ITEMS", "rental item")
    assert log.count() == 0 and "description" in log.columns


FEED = "op string, record_id long, label string, change_time timestamp_ntz"
CHILDREN = "guard int, op string, record_id long, change_time timestamp_ntz"
GUARDS = (("rental_delete", -20062), ("rental_delete", -20063))


def written(spark, rows, ddl, path, chunk):
    """Rows as files of a feed, in their order."""
    for n in range(0, len(rows), chunk):
        spark.createDataFrame(rows[n : n + chunk], ddl).coalesce(1).write.mode("append").parquet(path)


def moments(seed, n):
    import datetime
    import random

    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    at = lambda k: start + datetime.timedelta(hours=k)
    changes = [(rng.choice("IUDD"), rng.randint(1, 12), f"R{k}", at(rng.randint(0, 200))) for k in range(n)]
    children = []
    for _ in range(n):
        guard, record, came = rng.randint(0, 1), rng.randint(1, 14), rng.randint(0, 200)
        children.append((guard, "I", record, at(came)))
        if rng.random() < 0.6:
            children.append((guard, "D", record, at(came + rng.randint(0, 40))))
    changes += [("D", 99, None, at(5)), ("D", None, "nobody", at(5))]
    return changes, children


def brute_guards(changes, children):
    out = []
    for op, record, label, at in changes:
        code = None
        for guard, (_, number) in enumerate(GUARDS):
            there = sum(1 if o == "I" else -1 for g, o, r, t in children if g == guard and r == record and t <= at)
            if op == "D" and record is not None and there > 0 and code is None:
                code = number
        out.append((op, record, at, code))
    return sorted(out, key=repr)


def decided(decision):
    named = {"INSERT": "I", "UPDATE": "U", "DELETE": "D"}
    rows = decision.outcome("action", "record_id", "action_time").collect()
    return sorted(((named[r.action], r.record_id and int(r.record_id), r.action_time, r.code) for r in rows), key=repr)


def test_deletes_are_guarded_at_their_time(spark):
    changes, children = moments(3, 60)
    got = audit.audit_feed(spark.createDataFrame(changes, FEED), spark.createDataFrame(children, CHILDREN), "RENTALS", "rental", GUARDS)
    assert decided(got) == brute_guards(changes, children)
    assert {c for *_, c in decided(got)} == {None, -20062, -20063}


@pytest.mark.parametrize("files", [1, 50])
def test_guarded_stream_equals_batch(spark, tmp_path, files):
    """Feeds in the order of time: in small batches, stopped and gone on with, and in one."""
    changes, children = moments(4, 40)
    changes, children = sorted(changes, key=lambda r: r[3]), sorted(children, key=lambda r: r[3])
    middle = changes[len(changes) // 2][3]
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    for early in (True, False):
        for rows, ddl, name in ((changes, FEED, "changes"), (children, CHILDREN, "children")):
            part = [r for r in rows if (r[3] <= middle) == early]
            written(spark, part, ddl, str(tmp_path / name), 1000 if early else len(part))
        feeds = [jobs.file_stream(spark, str(tmp_path / name), files) for name in ("changes", "children")]
        got = keyed.run_guarded_audit(*feeds, "RENTALS", "rental", GUARDS, log, state)
    assert decided(got) == brute_guards(changes, children)


def test_latest_value_goes_back_after_deletes(spark, tmp_path):
    """Inserts, updates and deletes in any batches, stopped and gone on with."""
    import random

    rng = random.Random(7)
    live, events = {}, []
    for row in range(120):
        if live and rng.random() < 0.45:
            gone = rng.choice(list(live))
            events.append((*live.pop(gone), -1))
        live[row] = (rng.randint(1, 6), rng.randint(0, 30), rng.randint(1, 500))
        events.append((*live[row], 1))
    rows = [(k, sign, value, amount) for k, value, amount, sign in events]
    ddl, path = "key long, sign long, value long, amount long", str(tmp_path / "feed")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    got = None
    for half in (rows[:100], rows[100:]):
        written(spark, half, ddl, path, 30)
        got = keyed.run_tracked(jobs.file_stream(spark, path, files_per_trigger=2), out, state).collect()
    want = {}
    for k, value, amount in live.values():
        n, total, latest = want.get(k, (0, 0, -1))
        want[k] = (n + 1, total + amount, max(latest, value))
    assert {r.key: (r.n, r.total, r.latest) for r in got} == want


def test_results_of_a_feed_equal_the_batch(spark, changes):
    """Deletes that empty a key remove it; a delete before its insert is owed."""
    ddl = "key long, sign long, value long, amount long"
    rows = [(1, 1, 5, 10), (1, -1, 5, 10), (2, -1, 9, 3), (2, 1, 9, 3), (2, 1, 4, 1), (3, 1, 2, 2), (3, 1, 2, 2), (3, -1, 2, 2)]
    feed = spark.createDataFrame(rows, ddl)
    path = changes + "-signed"
    written(spark, rows, ddl, path, 2)
    got = keyed.run_tracked(jobs.file_stream(spark, path, files_per_trigger=1))
    batch = feed.groupBy("key").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("amount")).alias("total")).where("n > 0")
    assert sorted((r.key, r.n, r.total) for r in got.collect()) == sorted(map(tuple, batch.collect()))
    assert {r.key: r.latest for r in got.collect()} == {2: 4, 3: 2}


def test_results_of_a_feed_need_no_python_call_per_key(spark, changes):
    ddl, path = "key long, sign long, value long, amount long", changes + "-plan"
    written(spark, [(1, 1, 5, 10)], ddl, path, 1)
    plan = keyed.tracked(jobs.file_stream(spark, path))._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan and "Aggregate" in plan


def test_counts_of_many_batches_are_folded(spark, tmp_path, monkeypatch):
    """One file per batch; a delete far behind its children still meets them, one without time comes last."""
    import datetime

    monkeypatch.setattr(keyed, "FOLD", 2)
    at = lambda day: datetime.datetime(2024, 1, day)
    children = [(0, "I", 1, at(1)), (1, "I", 2, at(1)), (0, "D", 1, at(2)), (1, "I", 1, at(3)), (0, "I", 3, None)]
    changes = [("U", 9, "x", at(d)) for d in range(1, 5)] + [("D", r, "x", at(9)) for r in (1, 2, 3, 4)] + [("D", 3, "y", None)]
    folder = {name: str(tmp_path / name) for name in ("changes", "children", "log", "state")}
    written(spark, changes[:4], FEED, folder["changes"], 1)
    written(spark, children[:4], CHILDREN, folder["children"], 1)
    stream = lambda name: jobs.file_stream(spark, folder[name], 1)
    for late in (False, True):
        if late:
            written(spark, changes[4:], FEED, folder["changes"], 5)
            written(spark, children[4:], CHILDREN, folder["children"], 1)
        got = keyed.run_guarded_audit(stream("changes"), stream("children"), "RENTALS", "rental", GUARDS, folder["log"], folder["state"])
    codes = {(record, when): code for op, record, when, code in decided(got) if op == "D"}
    assert codes == {(1, at(9)): -20063, (2, at(9)): -20063, (3, at(9)): None, (4, at(9)): None, (3, None): -20062}
    assert (tmp_path / "state-counts" / "fold-4").exists()
