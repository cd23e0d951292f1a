"""Values by time against looking through all events."""

import datetime
import random

from gearledger.operators import timeline
from pyspark.sql import functions as F

START = datetime.datetime(2024, 1, 1)


def at(k):
    return None if k is None else START + datetime.timedelta(hours=k)


def test_last_value_before_a_moment(spark):
    """One key with most rows, equal times, NULL keys and moments before the first event."""
    rng = random.Random(1)
    events = [(None if n % 40 == 0 else 1 if n % 3 else rng.randint(2, 5), rng.randint(10, 60), n, f"v{n}") for n in range(300)]
    moments = [(rng.choice([None, 1, 1, 2, 9]), rng.randint(0, 70), k) for k in range(200)]
    told = timeline.as_of(
        spark.createDataFrame([(k, at(t), n, v) for k, t, n, v in events], "k long, t timestamp_ntz, n long, v string").repartition(5),
        spark.createDataFrame([(k, at(t), m) for k, t, m in moments], "k long, t timestamp_ntz, m long").repartition(3),
        ["k"], "t", ["n"], ["v"],
    )
    want = {}
    for k, t, m in moments:
        seen = [(u, n, v) for key, u, n, v in events if key == k and u <= t]
        want[m] = (k, at(t), max(seen)[2] if seen else None)
    assert {r.m: (r.k, r.t, r.v) for r in told.collect()} == want


def test_terms_that_overlap_and_leave_gaps(spark):
    rng = random.Random(2)
    terms = [(f"T{n:02d}", a := rng.randint(0, 100), a + rng.randint(-2, 12)) for n in range(25)]
    terms += [("TA", 50, 90), ("TB", 50, 90)]
    rows = [(k, rng.randint(0, 130)) for k in range(150)]
    ranges = spark.createDataFrame([(n, at(a), at(b)) for n, a, b in terms], "id string, a timestamp_ntz, b timestamp_ntz")
    rank = F.struct((-F.unix_micros(F.col("a").cast("timestamp"))).alias("s"), F.col("id"))
    frame = spark.createDataFrame([(k, at(d)) for k, d in rows], "row long, d timestamp_ntz")
    got = {r["row"]: r.found for r in timeline.in_force(frame, "d", ranges, "a", "b", rank, F.col("id"), "found").collect()}
    for k, d in rows:
        held = [(-a, n) for n, a, b in terms if a <= d <= b]
        assert got[k] == (min(held)[1] if held else None), d
    assert len(got) == len(rows)
    none = timeline.in_force(frame, "d", ranges.limit(0), "a", "b", rank, F.col("id"), "found")
    assert {r.found for r in none.collect()} == {None}
