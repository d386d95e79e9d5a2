"""The registered queries of this subpackage against SQL, and the pipeline stage by stage."""

import random

import numpy as np
import pytest

import check
import corpus_pipeline
from trackside.llm import common
from trackside.llm.common import components, contracted, may_contain, stored
from trackside.llm.nbsvm import quality
from trackside.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        ok, text = check.compare(spark, con, name, SF)
        assert ok, text
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), name)
        if name == "quality":
            want = {r.doc_id for r in quality(docs, labels).where("predicted = 1").collect()}
            assert {r.doc_id for r in after.collect()} == want
        if name == "near_duplicates":
            assert after.count() < docs.count()
        if name == "personal_data":
            assert after.count() == docs.count()
        if name != "packing":
            assert after.columns == columns
        docs = after
    whole = corpus_pipeline.run(spark, SF)
    order = sorted(whole.columns)
    assert sorted(map(str, whole.select("doc_id", "doc_tokens").distinct().collect())) == sorted(
        map(str, docs.select("doc_id", "doc_tokens").distinct().collect())
    )
    assert order == sorted(docs.columns)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, nothing, stage):
    assert stage(spark, nothing, SF).collect() == []
    out = stage(spark, odd, SF)
    out.collect()
    if stage is not corpus_pipeline.packed_sequences:
        assert out.columns == odd.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (200, 200)] + [(300, 300 + k) for k in range(1, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(51), 0), 90: 90, 95: 90, 100: 90, **dict.fromkeys(range(300, 340), 300)}


def test_edges_are_contracted_before_the_rounds(spark, monkeypatch):
    """A long path is one star in each task, so that the driver plans few rounds."""
    labels = []
    monkeypatch.setattr(common, "stored", lambda df, label: [stored(df, label), labels.append(label)][0])
    at = random.Random(4).sample(range(3000), 3000)
    path = spark.createDataFrame(list(zip(at, at[1:])) + [(7, 7), (5000, 4000)], "a long, b long").repartition(3)
    got = {r.node: r.component for r in components(path, "t").collect()}
    assert got == {**dict.fromkeys(range(3000), 0), 4000: 4000, 5000: 4000}
    assert labels.count("t-round") <= 4


def test_edges_left_for_the_rounds_do_not_follow_the_tasks(spark, monkeypatch):
    """Large components over many tasks: about an edge a node is joined in each round, not one for each task that met the node."""
    kept = []
    monkeypatch.setattr(common, "stored", lambda df, label: [out := stored(df, label), kept.append((label, out.count()))][0])
    rnd = random.Random(8)
    edges = [(x, y) for x, y in (rnd.sample(range(600), 2) for _ in range(6000)) if x % 2 == y % 2]
    settings = {"spark.sql.shuffle.partitions": "128", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(16), "t").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {x: x % 2 for edge in edges for x in edge}
    assert [n for label, n in kept if label == "t-edges"][-1] <= 1.5 * len(got)


@pytest.mark.parametrize("seed", range(5))
def test_contracted(seed):
    rnd = np.random.default_rng(seed)
    a, b = rnd.integers(-60, 60, (2, 70))
    low, high = contracted(a, b)
    assert (low < high).all() and len(np.unique(high)) == len(high) and not np.isin(low, high).any()
    known = {x: {x} for x in range(-60, 60)}
    for x, y in zip(a, b):
        both = known[x] | known[y]
        known.update(dict.fromkeys(both, both))
    smallest = dict(zip(high.tolist(), low.tolist()))
    assert all(smallest.get(x, x) == min(known[x]) for x in known)


def test_filter_keeps_what_it_holds(spark):
    df = spark.range(5000)
    some = df.where("id % 50 = 0")
    hit = {r.id for r in df.where(may_contain(some)("id")).collect()}
    assert set(range(0, 5000, 50)) <= hit and len(hit) < 150
