"""As-of join, down-sampling and window aggregates against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from trackside.operators.asof import asof_join
from trackside.operators.interval import Measure, interval_aggregate
from trackside.operators.sampling import downsample, rank_rows

T0 = datetime(2025, 1, 1)
LEFT = "id long, k long, ts timestamp_ntz"
RIGHT = "k long, ts timestamp_ntz, rid long, v long"


def ts(second):
    return None if second is None else T0 + timedelta(seconds=second)


def brute_asof(left, right):
    out = {}
    for id_, k, t in left:
        fits = [r for r in right if None not in (k, t, r[0], r[1]) and r[0] == k and r[1] <= t]
        best = max(fits, key=lambda r: (r[1], r[2]), default=None)
        out[id_] = None if best is None else (best[2], best[3])
    return out


def run_asof(spark, left, right, how="left", **options):
    joined = asof_join(
        spark.createDataFrame(left, LEFT),
        spark.createDataFrame(right, RIGHT),
        by=["k"],
        on="ts",
        tie_break=["rid"],
        how=how,
        **options,
    )
    return {r.id: None if r.rid is None else (r.rid, r.v) for r in joined.collect()}


EDGES_LEFT = [(1, 1, ts(0)), (2, 1, ts(5)), (3, 1, ts(10)), (4, None, ts(5)), (5, 1, None), (6, 2, ts(5)), (7, 1, ts(99))]
EDGES_RIGHT = [(1, ts(5), 10, 1), (1, ts(5), 11, None), (1, ts(9), 12, 3), (None, ts(1), 13, 4), (1, None, 14, 5)]


def test_asof_edges(spark):
    got = run_asof(spark, EDGES_LEFT, EDGES_RIGHT)
    # Inclusive at 5 s with the greatest tie-break, whose NULL value is kept.
    assert got == {1: None, 2: (11, None), 3: (12, 3), 4: None, 5: None, 6: None, 7: (12, 3)}
    assert run_asof(spark, EDGES_LEFT, EDGES_RIGHT, how="inner") == {2: (11, None), 3: (12, 3), 7: (12, 3)}
    assert run_asof(spark, EDGES_LEFT, [], how="inner") == {}


@pytest.mark.parametrize("bucket_seconds", [10**6, 7, 0.5])
def test_asof_with_a_hot_key_and_a_hot_instant(spark, bucket_seconds):
    rng = random.Random(3)
    left, right = [], []
    for i in range(400):
        key = 1 if rng.random() < 0.5 else rng.randint(2, 6)
        second = 50 if rng.random() < 0.3 else rng.randint(0, 100)
        left.append((i, key, ts(second)))
    for i in range(300):
        key = 1 if rng.random() < 0.5 else rng.randint(2, 6)
        second = 50 if rng.random() < 0.3 else rng.randint(0, 100)
        right.append((key, ts(second), i, rng.choice([None, i])))
    got = run_asof(spark, left, right, bucket_seconds=bucket_seconds)
    assert got == brute_asof(left, right)


def test_asof_is_one_plan_without_nested_loops(spark):
    left, right = spark.createDataFrame(EDGES_LEFT, LEFT), spark.createDataFrame(EDGES_RIGHT, RIGHT)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    joined = asof_join(left, right, by=["k"], on="ts", tie_break=["rid"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before  # nothing runs to plan it
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_asof_rejects_clashing_columns(spark):
    left = spark.createDataFrame([], "k long, ts timestamp_ntz, v long")
    with pytest.raises(ValueError, match="rename"):
        asof_join(left, spark.createDataFrame([], RIGHT), by=["k"], on="ts")


def series(n, key=1):
    return [(key, T0 + timedelta(seconds=i), i + 1) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 1499, 1500, 2500, 3500])
def test_downsample_half_even(spark, n):
    df = spark.createDataFrame(series(n), "k long, ts timestamp_ntz, i long")
    kept = downsample(df, by=["k"], order=["ts", "i"], target=1000, cap=1000)
    step = round(n / 1000) if n > 1000 else 1
    assert sorted(r.i for r in kept.collect()) == [i for i in range(1, n + 1) if i % step == 0][:1000]


@pytest.mark.parametrize("n", [1499, 1500, 3100])
def test_downsample_floor(spark, n):
    df = spark.createDataFrame(series(n), "k long, ts timestamp_ntz, i long")
    kept = downsample(df, by=["k"], order=["ts", "i"], target=1500, rounding="floor")
    step = max(1, n // 1500)
    assert sorted(r.i for r in kept.collect()) == [i for i in range(1, n + 1) if i % step == 0]


@pytest.mark.parametrize("widths", [None, [10**7], [10**6, 50], [1, 1]])
def test_rank_with_hot_and_null_keys_and_null_times(spark, widths):
    rng = random.Random(5)
    rows = []
    for i in range(500):
        key = rng.choice([None, 1, 1, 1, 2, 3])
        second = 30 if rng.random() < 0.4 else rng.randint(0, 60)
        rows.append((key, None if rng.random() < 0.1 else T0 + timedelta(seconds=second), i))
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, i long")
    got = {r.i: (r.rn, r.n) for r in rank_rows(df, by=["k"], order=["ts", "i"], widths=widths).collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or T0, r[2]))
        for place, row in enumerate(group, 1):
            expected[row[2]] = (place, len(group))
    assert got == expected


MEASURES = [
    Measure("n", "count"),
    Measure("total", "sum", "v"),
    Measure("mean", "avg", "v"),
    Measure("low", "min", "v"),
    Measure("high", "max", "v"),
]


def brute_windows(events, rows, before, after):
    out = {}
    for id_, k, t in events:
        hit = [
            v
            for key, s, v in rows
            if None not in (k, t, s) and key == k and t - timedelta(seconds=before) <= s <= t + timedelta(seconds=after)
        ]
        known = [v for v in hit if v is not None]
        out[id_] = (
            len(hit),
            sum(known) if known else None,
            sum(known) / len(known) if known else None,
            min(known, default=None),
            max(known, default=None),
        )
    return out


@pytest.mark.parametrize("slices", [1, 2, 20])
@pytest.mark.parametrize("few", [False, True])
def test_interval_aggregate(spark, slices, few):
    rng = random.Random(11)
    events = [(i, rng.choice([None, 1, 1, 2]), ts(rng.randint(0, 300))) for i in range(60)] + [(60, 1, None)]
    rows = [(rng.choice([None, 1, 1, 2]), ts(rng.randint(-20, 320)), rng.choice([None, rng.randint(0, 99)])) for _ in range(400)]
    # On both borders of event 61's window, and one microsecond past them.
    events.append((61, 9, ts(100)))
    micro = timedelta(microseconds=1)
    rows += [(9, ts(95), 1), (9, ts(115), 2), (9, ts(95) - micro, 50), (9, ts(115) + micro, 60)]
    got = interval_aggregate(
        spark.createDataFrame(events, LEFT),
        spark.createDataFrame(rows, "k long, ts timestamp_ntz, v long"),
        by=["k"],
        event_ts="ts",
        series_ts="ts",
        before_seconds=5,
        after_seconds=15,
        measures=MEASURES,
        few_events=few,
        slices=slices,
    )
    found = {r.id: (r.n, r.total, r["mean"], r.low, r.high) for r in got.collect()}
    assert found == brute_windows(events, rows, 5, 15)
    assert found[61] == (2, 3, 1.5, 1, 2)


def test_interval_inner_and_plan(spark):
    events = spark.createDataFrame([(1, 1, ts(0)), (2, 1, ts(500))], LEFT)
    rows = spark.createDataFrame([(1, ts(1), 7)], "k long, ts timestamp_ntz, v long")
    got = interval_aggregate(
        events, rows, by=["k"], event_ts="ts", series_ts="ts", after_seconds=15, measures=MEASURES, how="inner"
    )
    assert [r.id for r in got.collect()] == [1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_same_result_whatever_the_number_of_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for count in ("1", "3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", count)
            results.append(run_asof(spark, EDGES_LEFT, EDGES_RIGHT))
        assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


