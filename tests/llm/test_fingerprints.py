"""I-Match against a plain computation."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from trackside.llm import imatch

SF = "/root/testdata/sf0.001"


def terms(text):
    return set(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)))


@pytest.mark.parametrize("rows_per_range", [20_000, 40])
def test_edits(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(imatch, "ROWS_PER_RANGE", rows_per_range)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    got = {r.doc_id: r for r in imatch.fingerprinted(docs).collect()}
    rows = docs.orderBy("doc_id").collect()
    assert len(got) == len(rows)
    prints = {}
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        found, cut = got[r.doc_id], len(r.text) // 4
        edited = r.text[: len(r.text) - cut] + after.text[:cut]
        assert found.n_chars == len(r.text)
        assert found.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(r.text, found.fingerprint) == found.fingerprint
        assert found.near_edited == imatch.likeness(found.fingerprint, found.edited_fingerprint)
        assert found.near_next == imatch.likeness(found.fingerprint, got[after.doc_id].fingerprint)
    assert np.mean([r.near_edited for r in got.values()]) > 0.1 + np.mean([r.near_next for r in got.values()])


def test_lexicon_is_the_band(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = Counter(t for r in docs.collect() for t in terms(r.text))
    n = docs.count()
    want = sum(imatch.LEAST * n < f <= imatch.MOST * n for f in df.values())
    assert len(imatch.lexicon(docs.select("text").repartition(4)).terms) == want
    counted = imatch.document_frequencies(docs.select("text").repartition(4)).collect()
    assert Counter(r.df for r in counted) == Counter(df.values())


def test_odd_rows(spark, odd, odd_rows, nothing):
    got = imatch.fingerprinted(odd).collect()
    assert len(got) == len(odd_rows)
    texts = {r[0]: r[1] or "" for r in odd_rows if r[0] not in (None, 41)}
    prints = {}
    for r in got:
        if r.doc_id in texts:
            assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
            assert r.n_chars == len(texts[r.doc_id])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert imatch.fingerprinted(nothing).collect() == []
    (one,) = imatch.fingerprinted(odd.where("doc_id = 1")).collect()
    assert one.near_next == 1.0


def test_likeness():
    assert imatch.likeness("0000" * 3, "0000" * 3) == 1.0
    assert imatch.likeness("00010002" + "0000", "00010003" + "0000") == 0.5
    assert imatch.likeness("0001" + "0000", "0000" + "0000") == 0.0
