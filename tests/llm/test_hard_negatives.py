"""Hard negatives against every score."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackside.llm.hard_negatives import Lists, mined, negatives, positives, settled, window

SCHEMA = "vec_id long, embedding array<double>, label int, id long, vector string, n int"
LONG = (1 << 63) - 1


def brute(rows, every=50, n_positives=5, n_negatives=3):
    scaled = {}
    for i, v, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(r[1] or []), r[2] or 0, [x or 0 for x in r[1] or []])):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        scaled.setdefault(i, (label, [max(-LONG - 1, min(LONG, math.floor(x * 256))) for x in v]))
    out = []
    for a, (label, x) in scaled.items():
        if a % every:
            continue
        scores = sorted(
            (-max(-LONG, min(LONG, sum(p * q for p, q in zip(x, y)))), i, of) for i, (of, y) in scaled.items() if i != a and len(y) == len(x)
        )
        for s, p, _ in [t for t in scores if t[2] == label][:n_positives]:
            fit = [t for t in scores if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:n_negatives]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def random_rows(seed, n, d, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, d)) * 0.3
    label = rng.integers(0, labels, n)
    vectors = centres[label] + rng.standard_normal((n, d)) * 0.2
    vectors[n // 2 : n // 2 + n // 5] = vectors[n // 2]  # many equal rows
    return [(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(vectors, label))]


@pytest.mark.parametrize("block,anchors", [(4096, 64), (40, 3)])
def test_same_as_all_scores(spark, block, anchors):
    rows = random_rows(1, 400, 12)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    found = got(mined(df, F.col("id") % 10 == 0, block=block, anchors_in_block=anchors))
    assert found == brute(rows, 10) and len(found) > 100


def test_odd_rows(spark):
    rows = random_rows(2, 60, 3, 2)
    rows += [(100, None, 1), (101, [1.0, None, 1.0], 1), (102, [1.0, float("nan"), 1.0], 1), (103, [float("inf"), 1.0, 1.0], 1), (104, [], 1)]
    rows += [(105, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (50, [9.0], 1), (20, rows[20][1], rows[20][2])]
    rows += [(200, [1.0, 2.0], 5), (150, [0.0, 0.0, 0.0], 1), (250, [1.0, 2.0, 3.0, 4.0], 9), (251, [1.0, 2.0, 3.0, 4.0], 9)]
    rows += [(300, [1e30] * 5, 3), (301, [1e30] * 5, 3), (302, [5e29] * 5, 4), (303, [1.0] * 5, 4), (304, [-1e300] * 5, 4)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    assert got(mined(df, F.col("id") % 50 == 0)) == brute(rows)
    assert mined(df.where("false"), F.col("id") % 50 == 0).collect() == []
    assert mined(df.where("vec_id = 200"), F.col("id") % 50 == 0).collect() == []
    assert mined(df, F.lit(False)).collect() == []


def test_lists_stop_early_and_lose_nothing():
    rng = np.random.default_rng(5)
    rows = rng.integers(-200, 200, (3000, 3))
    lists, other = Lists(np.arange(3000), rows), rng.random(3000) < 0.7
    early = 0
    for k in range(0, 3000, 100):
        scores = rows @ rows[k]
        ids, found = positives(lists, k, rows[k], 5)
        want = sorted((-s, i) for i, s in enumerate(scores) if i != k)[:5]
        assert [(-s, i) for i, s in zip(ids, found)] == want
        ranges = [window(int(s)) for s in found if s >= 0]
        for (low, high), (ids, found) in zip(ranges, negatives(lists, other, rows[k], ranges, 3)):
            want = sorted((-s, i) for i, s in enumerate(scores) if other[i] and low <= s <= high)[:3]
            assert [(-s, i) for i, s in zip(ids, found)] == want
        seen = 0
        for new, score, bound in lists.scored(rows[k]):
            seen += len(new)
            if settled(score, bound, 5):
                break
        early += seen < 1500
    assert early > 10


def test_threshold_bounds_what_is_not_met():
    rng, rnd = np.random.default_rng(6), random.Random(6)
    for _ in range(30):
        rows = rng.integers(-5, 6, (rnd.randint(1, 200), rnd.randint(1, 6)))
        anchor, met = rng.integers(-5, 6, rows.shape[1]), np.zeros(len(rows), bool)
        for new, score, bound in Lists(np.arange(len(rows)), rows).scored(anchor):
            assert (score == rows[new] @ anchor).all() and not met[new].any()
            met[new] = True
            assert bound is None or ((rows @ anchor)[~met] <= bound).all()
        assert met.all()


def test_ties_do_not_settle():
    scores = np.array([7, 7, 5])
    assert not settled(scores, 5, 3) and settled(scores, 4, 3) and not settled(scores, 4, 4)
    assert settled(np.zeros(0, np.int64), 3, 3, low=4) and not settled(np.zeros(0, np.int64), 4, 3, low=4)
