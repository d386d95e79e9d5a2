"""One-bit codes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackside.llm.rabitq import Codes, exact, nearest, rotation, search

SCHEMA = "vec_id long, embedding array<double>, id long, vector string"


def brute(rows, every, top):
    rows = {i: np.array(v) for i, v in rows}
    out = {}
    for q, x in rows.items():
        if q % every == 0:
            scores = [(-exact(v[None, :], x)[0], i) for i, v in rows.items() if i != q and len(v) == len(x)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:top]]
    return out


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize("blocks", [(16_384, 4096), (60, 7)])
def test_exact_on_small_sets(spark, blocks):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((300, 24)) * rng.uniform(0.1, 3, (300, 1)) + 0.5
    vectors[100:180] = vectors[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(4)
    got = found(search(df, F.col("id") % 5 == 0, top=12, candidates=blocks[0], queries=blocks[1]))
    want = brute(rows, 5, 12)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / sum(map(len, want.values())) > 0.99
    assert all(got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) for q in got)


def test_odd_rows(spark):
    bad = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [bad[0], 1.0]),
        (7, [1.0, -bad[1]]), (8, [1.0, 2.0, 3.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (1, [2.0, 1.0]), (9, [2.0, 1.0]),
        (20, [5.0]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = found(search(df, F.col("id") % 2 == 0))
    assert got == {0: [(1, 4.0), (9, 4.0)], 8: [(10, 1.0)], 10: [(8, 1.0)]}
    assert search(df.where("false"), F.col("id") % 2 == 0).collect() == []
    assert search(df.where("vec_id = 4"), F.col("id") % 2 == 0).collect() == []


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(8)
    rows, queries = rng.standard_normal((500, 64)), rng.standard_normal((20, 64))
    mean = rows.mean(0)
    estimate, error = Codes(rows, mean).estimates(queries, mean)
    apart = np.abs(estimate - queries @ rows.T)
    assert (apart <= 3.5 * error).mean() > 0.999
    assert (apart <= 0.5 * error).mean() < 0.9
    assert np.allclose(rotation(64) @ rotation(64).T, np.eye(64))


def test_own_row_is_no_candidate():
    ids, rows = np.array([3, 5]), np.eye(2)
    out = list(nearest(ids, rows, np.array([3, 4]), rows, rows.mean(0), 20, 3.5))
    assert [(q, i.tolist()) for q, i, _ in out] == [(3, [5]), (4, [5, 3])]
