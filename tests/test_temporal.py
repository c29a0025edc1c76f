"""Joins and groups along time against plain loops, with hot keys, nulls, ties and empty tables."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import temporal

T0 = datetime(2024, 1, 1)
LEFT, RIGHT = "id long, user long, at timestamp, note string", "n long, user long, at timestamp, _t string"


def rows(n, seed, users, days=20, none=0.05):
    """Half of all rows are of user 0; many share a time."""
    rng = random.Random(seed)
    pick = lambda x: None if rng.random() < none else x
    return [(i, pick(0 if rng.random() < 0.5 else rng.randrange(users)), pick(T0 + timedelta(minutes=10 * rng.randrange(days * 144))), "x") for i in range(n)]


@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("width", [600, 86400, 10**8])
def test_as_of(spark, equal, width):
    a, b = rows(600, 1, 12), rows(500, 2, 10)
    left, right = spark.createDataFrame(a + a[:5], LEFT), spark.createDataFrame(b, RIGHT)
    got = temporal.as_of(left, right, ["user"], "at", "at", "last", width, equal, tie="n")
    want = []
    for i, user, at, note in a + a[:5]:
        before = [r for r in b if r[1] is not None and r[1] == user and r[2] is not None and at is not None and (r[2] <= at if equal else r[2] < at)]
        want.append((i, user, at, note, max(before, key=lambda r: (r[2], r[0]))[0] if before else None))
    assert sorted(map(tuple, got.select(*left.columns, "last.n").collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == [*left.columns, "last"]


def test_as_of_empty(spark):
    left, right = spark.createDataFrame(rows(20, 1, 3), LEFT), spark.createDataFrame([], RIGHT)
    out = temporal.as_of(left, right, ["user"], "at", "at", "last", 3600)
    assert out.count() == 20 and out.where("last is not null").isEmpty()
    assert temporal.as_of(left.limit(0), right, ["user"], "at", "at", "last", 3600).collect() == []


def test_as_of_spreads_a_hot_key(spark):
    """One user, one row a minute: no group of the sort has more rows than a bucket has minutes."""
    hot = spark.range(20_000).select(F.lit(1).cast("long").alias("user"), F.timestamp_seconds(F.col("id") * 60).alias("at"), "id")
    out = temporal.as_of(hot, hot.withColumnRenamed("id", "n"), ["user"], "at", "at", "last", width=3600)
    assert out.where("last.n = id - 1").count() == 19_999
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("unit", [3600, 86400])
def test_within_intervals(spark, unit):
    rng = random.Random(3)
    points = rows(500, 4, 6)
    spans = []
    for i in range(200):
        user = None if i % 19 == 0 else rng.randrange(6)
        start = None if i % 23 == 0 else T0 + timedelta(minutes=10 * rng.randrange(2880))
        end = None if i % 17 == 0 or start is None else start + timedelta(minutes=10 * rng.choice([-5, 0, 1, 6, 143, 144, 145, 1000, 2000]))
        spans.append((i, user, start, end))
    p = spark.createDataFrame(points, LEFT)
    s = spark.createDataFrame([*spans, (998, 0, datetime(1960, 1, 1), datetime(2060, 1, 1)), (999, 1, datetime(1950, 1, 1), datetime(1951, 1, 1))], "span long, user long, start timestamp, end timestamp")
    out = temporal.within_intervals(p, s, ["user"], "at", "start", "end", unit)
    got = sorted((r[0], r[1]) for r in out.select("point.id", "interval.span").collect())
    want = sorted((i, k) for i, u, at, _ in points for k, v, a, b in map(tuple, s.collect()) if None not in (u, v, at, a, b) and u == v and a <= at <= b)
    assert got == want and len(want) > 300
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert temporal.within_intervals(p, s.limit(0), ["user"], "at", "start", "end").collect() == []
    assert temporal.within_intervals(p.limit(0), s, ["user"], "at", "start", "end").collect() == []


@pytest.mark.parametrize("width", [7201, 86400, 10**8])
def test_sessions(spark, width):
    events = rows(900, 5, 9, days=9) + [(i, 77, T0 + timedelta(minutes=119 * i), "x") for i in range(300)]
    got = temporal.sessions(spark.createDataFrame(events, LEFT), ["user"], "at", 7200, width)
    want = []
    for user in {r[1] for r in events}:
        times = sorted(r[2] for r in events if r[1] == user and r[2] is not None)
        part = []
        for t in times:
            if part and t - part[-1] > timedelta(hours=2):
                want.append((user, part[0], part[-1], len(part)))
                part = []
            part.append(t)
        if part:
            want.append((user, part[0], part[-1], len(part)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert (77, T0, T0 + timedelta(minutes=119 * 299), 300) in want
    with pytest.raises(ValueError):
        temporal.sessions(got, ["user"], "start", 10, 10)


def test_sessions_empty(spark):
    assert temporal.sessions(spark.createDataFrame([], LEFT), ["user"], "at", 60, 3600).collect() == []


def test_as_of_has_parts_by_its_size(spark, monkeypatch):
    """With many small partitions the result is the same, and each exchange but the carried buckets' has them."""
    left = spark.range(3000).selectExpr("id % 7 as k", "timestamp_seconds(id * 7919 % 100000) as at", "id")
    right = spark.range(500).selectExpr("id % 8 as k", "timestamp_seconds(id * 104729 % 100000) as t", "id as n")
    run = lambda: temporal.as_of(left, right, ["k"], "at", "t", "last", width=3600, tie="n")
    want = sorted(map(str, run().collect()))
    monkeypatch.setattr(temporal, "PART_ROWS", 100)
    plan = run()._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 36), REPARTITION_BY_NUM") >= 5
    assert sorted(map(str, run().collect())) == want
