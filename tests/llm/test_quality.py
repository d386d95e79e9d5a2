"""The classifier: held-out accuracy, odd rows, and the parts by themselves."""

import zlib

import numpy as np

from trackside.llm.nbsvm import FEATURES, Model, calibrate, class_counts, descend, features, fit, kept_by_quality, quality

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50
    assert np.mean([p.predicted == q for p, q in held]) > 0.95


def test_labels_outside_training_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr(
        "doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality"
    )
    a, b = (quality(docs.limit(100), x).select("doc_id", "score") for x in (labels, turned))
    assert {(r.doc_id, r.score) for r in a.collect()} == {(r.doc_id, r.score) for r in b.collect()}


def test_counts_cover_all_rows(spark, odd_rows):
    rows = [(r[1] or "", i % 2) for i, r in enumerate(odd_rows)]
    counts, n = class_counts(spark.createDataFrame(rows, "text string, label int").repartition(3))
    want = np.zeros((2, FEATURES), np.int64)
    for text, label in rows:
        (columns,) = features([text.encode()])
        assert len(set(columns.tolist())) == len(columns)
        want[label, columns] += 1
    assert (counts == want).all() and n.tolist() == [sum(1 - x for _, x in rows), sum(x for _, x in rows)]


def test_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(3, None), (None, 1), (5, 7)], "doc_id long, quality int")
    got = quality(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r, text in [(r, t[1] or "") for r in got for t in odd_rows if t[0] == r.doc_id and t[0] not in (41, None)]:
        assert by_text.setdefault(text, r.score) == r.score
    assert quality(nothing, labels).collect() == []
    assert kept_by_quality(odd, labels).columns == odd.columns


def test_one_class_or_none(spark, odd, odd_rows):
    good = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert kept_by_quality(odd, good).count() == len(odd_rows)
    assert {r.score for r in quality(odd, good.where("false")).collect()} == {0.5}


def test_descent_separates():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(60):
        y = k % 2
        columns = np.array([y, 2 + rng.integers(50), 60 + rng.integers(50)], np.int32)
        rows.append((np.unique(columns), np.ones(len(np.unique(columns)))))
        labels.append(2.0 * y - 1)
    w = descend(rows, np.array(labels), 1.0, 30)
    assert all(y * (w[c] @ v + w[-1]) > 0 for (c, v), y in zip(rows, labels))
    slope, shift = calibrate(np.linspace(-2, 2, 100), np.linspace(-2, 2, 100) > 0.5, np.ones(100))
    assert slope > 0 > shift


def test_empty_model():
    model = Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, 1.0, 0.0)
    assert model.scores([b"", b"any text"]).tolist() == [0.5, 0.5]


def test_long_text(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "word " * 10) for i in range(30)] + [(99, "long text " * 200_000)], "doc_id long, text string")
    model = fit(docs, labels)
    assert 0 <= model.scores([b"long text " * 200_000])[0] <= 1
