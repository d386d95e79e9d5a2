"""Substring operators against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from trackside.llm.sketch import build
from trackside.llm.substring_windows import remove_repeated_windows
from trackside.llm.suffix_repeats import intervals, remove_repeated_strings

SF = "/root/testdata/sf0.001"
LAST = 1 << 63


def ordered(rows):
    return sorted(rows, key=lambda r: (LAST if r[0] is None else r[0]))


def removed_units(rows, units_of, window):
    """Per row: units and which go. Rows with equal ids are not earlier than one another."""
    first = {}
    rows = [(LAST if r[0] is None else r[0], units_of(r[1] or "")) for r in rows]
    for doc, units in rows:
        for i in range(len(units) - window + 1):
            key = tuple(units[i : i + window])
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    for doc, units in rows:
        gone = np.zeros(len(units), bool)
        for i in range(len(units) - window + 1):
            if first[tuple(units[i : i + window])] != (doc, i):
                gone[i : i + window] = True
        yield doc, units, gone


def split(text):
    return text.encode().split()


@pytest.mark.parametrize(("hot", "bits"), [(2000, 20), (2, 20), (2000, 19)])
def test_windows(spark, odd, odd_rows, hot, bits):
    want = Counter()
    for doc, units, gone in removed_units([(r[0], r[1]) for r in odd_rows], split, 20):
        kept = b" ".join(u for u, g in zip(units, gone) if not g)
        want[(None if doc == LAST else doc, len(units), int(gone.sum()), hashlib.sha256(kept).hexdigest())] += 1
    got = remove_repeated_windows(odd, hot=hot, width_bits=bits)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want


@pytest.mark.parametrize("hot", [2000, 2])
def test_strings(spark, odd, odd_rows, hot):
    want = Counter()
    for doc, units, gone in removed_units([(r[0], r[1]) for r in odd_rows if r[0] != 60], lambda t: t.encode(), 100):
        kept = bytes(u for u, g in zip(units, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(None if doc == LAST else doc, len(units), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = remove_repeated_strings(odd.where("doc_id is null or doc_id <> 60"), hot=hot, width_bits=20)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d: int(g.sum()) for d, _, g in removed_units(rows, split, 20)}
    assert {r.doc_id: r.n_removed for r in remove_repeated_windows(docs).collect()} == want
    want = {d: int(g.sum()) for d, _, g in removed_units(rows, lambda t: t.encode(), 100)}
    assert {r.doc_id: r.n_removed for r in remove_repeated_strings(docs).collect()} == want


def test_nothing(nothing):
    assert remove_repeated_windows(nothing).collect() == []
    assert remove_repeated_strings(nothing).collect() == []


def test_interval_tree():
    found = intervals([b"abc", b"abd", b"abd", b"b", b"bb"], 0)
    assert sorted(found) == [(0, 0, 4), (1, 3, 4), (2, 0, 2), (3, 1, 2)]


def test_sketch_never_misses(spark):
    keys = np.random.default_rng(1).integers(0, 3000, 6000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    df = spark.createDataFrame([(int(k.view(np.int64)),) for k in keys], "k long").repartition(4)
    sketch = build(df, lambda b: [np.asarray(b.column(0)).view(np.uint64)], 19, hot=4)
    values, counts = np.unique(keys, return_counts=True)
    assert sketch.is_repeated(values[counts > 1]).all()
    assert sketch.is_hot(values[counts >= 4]).all()
    assert sketch.is_repeated(values[counts == 1]).mean() < 0.05


@pytest.mark.parametrize("unit", ["x", "ab"])
def test_long_repetitive_text(spark, unit):
    """Every window is a candidate; the same answer as for a short one."""
    short = 3000 // len(unit)
    ((_, _, gone),) = removed_units([(1, unit * short)], lambda t: t.encode(), 100)
    assert int(gone.sum()) == short * len(unit) - len(unit)
    size = 5 << 20
    docs = spark.createDataFrame([(1, unit * (size // len(unit)))], "doc_id long, text string")
    (got,) = remove_repeated_strings(docs).drop("kept").collect()
    assert (got.n_bytes, got.n_removed, got.n_spans) == (size, size - len(unit), 1)
