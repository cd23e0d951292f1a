"""Running totals and numbers against plain Python, with hot keys and equal rows."""

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gearledger.operators import numbering


def test_running_total_per_group_over_levels(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice(["hot"] * 6 + ["a", "b", None]), day, hour, n, rng.randint(0, 9))
        for n, (day, hour) in enumerate(
            (rng.randint(1, 3), rng.randint(0, 4)) for _ in range(400)
        )
    ]
    df = spark.createDataFrame(rows, "g string, day int, hour int, id long, v int")
    got = numbering.running_total(
        df.withColumn("w", F.col("v") * 2), ["g"], ["day", "hour", "id"], {"a": "v", "b": "w"}
    )
    want, sums = {}, defaultdict(int)
    for g, day, hour, n, v in sorted(rows, key=lambda r: r[1:4]):
        want[n] = (sums[g], 2 * sums[g])
        sums[g] += v
    assert {r.id: (r.a, r.b) for r in got.collect()} == want


@settings(max_examples=8, deadline=None)
@given(
    keys=st.sets(
        st.one_of(st.integers(0, 50), st.integers(2**20 - 3, 2**20 + 3),
                  st.integers(2**40 - 3, 2**40 + 3), st.integers(2**62, 2**62 + 5)),
        min_size=1, max_size=40,
    ),
    told=st.booleans(),
)
def test_dense_number(spark, keys, told):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    top = numbering.top_key(df, "k") if told else None
    got = {r.k: r.n for r in numbering.dense_number(df, "k", "n", top).collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys), start=1)}


def test_dense_number_by_time(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**7), 300)
    rows = [(f"2024-01-0{rng.randint(1, 3)} 0{rng.randint(0, 2)}:00:00", k) for k in ids]
    df = spark.createDataFrame(rows, "t string, k long").withColumn(
        "t", F.col("t").cast("timestamp_ntz")
    )
    got = {r.k: r.n for r in numbering.dense_number_by_time(df, "t", "k", "n").collect()}
    assert got == {k: n for n, (_, k) in enumerate(sorted(rows), start=1)}


def _numbers(df, group_rows):
    got = numbering.number_in_group(df, ["g"], ["a", "b"], "n", group_rows)
    return sorted((tuple(r) for r in got.select("g", "a", "b", "n").collect()), key=str)


def test_number_in_group_splits_hot_groups(spark, monkeypatch):
    """One group with a third of the rows, many of them equal: same numbers as one window."""
    monkeypatch.setattr(numbering, "COPY_BLOCK", 7)
    rng = random.Random(3)
    rows = [(1, rng.randint(0, 3), rng.randint(0, 5)) for _ in range(300)]
    rows += [(1, 2, 2)] * 100 + [(1, None, 4)] * 5
    rows += [(g, rng.randint(0, 9), rng.randint(0, 9)) for g in range(2, 200) for _ in range(4)]
    df = spark.createDataFrame(rows, "g long, a int, b long")
    plain = _numbers(df, 10**6)
    assert len(plain) == len(rows)
    assert _numbers(df, 50) == plain


def test_windows_see_bounded_groups(spark):
    """The numbering plan has no window over raw rows without a partition key."""
    df = spark.range(10).withColumnRenamed("id", "k")
    plan = numbering.dense_number(df, "k", "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 3
    assert "_one" not in windows[-1]

def test_the_null_group_is_split_too(spark):
    rows = [(None, i % 7) for i in range(300)] + [(1, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g long, k long")
    got = numbering.number_in_group(df, ["g"], ["k"], "n", group_rows=50)
    plain = {}
    for g, k, n in sorted(((r.g, r.k, r.n) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        plain.setdefault(g, []).append((k, n))
    for g, pairs in plain.items():
        assert [n for _, n in pairs] == list(range(1, len(pairs) + 1))
        assert [k for k, _ in pairs] == sorted(k for k, _ in pairs)


def test_many_moments_in_one_day(spark):
    df = spark.range(3000).selectExpr(
        "timestamp_micros((id * 7919) % 3000 * 1000 + 86400000000) AS t", "id AS key")
    got = numbering.dense_number_by_time(df, "t", "key", "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 3001))
    assert [(r.t, r.key) for r in got] == sorted((r.t, r.key) for r in got)


def test_no_join_on_a_coarse_value(spark):
    """Rows that share their coarse values are not brought together by them: they are shuffled once, by the finest level."""
    df = spark.range(5000).selectExpr("id % 3 AS g", "CAST(NULL AS bigint) AS high", "id DIV 100 AS mid", "id AS k", "1 AS one")
    counted = numbering.running_total(df, ["g"], ["high", "mid", "k"], {"n": "one"})
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(counted.collect(), key=lambda r: (r.g, r.k))
    assert [r.n for r in rows] == [i for g in range(3) for i in range(len(range(g, 5000, 3)))]
    assert counted.columns == ["g", "high", "mid", "k", "one", "n"]
