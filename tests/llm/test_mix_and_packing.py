"""Mixing and packing: targets, bounds, round trips."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackside.llm.packing import Encoder, Schedule, packed
from trackside.llm.source_mix import mixed, repeated_by_mix

SF = "/root/testdata/sf0.01"


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > most * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: rest * weight[s] / w for s in open_}
        fixed |= {s: most * sizes[s] for s in over}


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("name", ["given", "odd"])
def test_targets_and_bounds(spark, odd, name):
    docs = odd if name == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows, got = docs.collect(), mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1, s
        epochs = int(want[s] // sizes[s]) if sizes[s] else 0
        assert all(r.copies >= epochs for r in got if r.source == s)
    again = mixed(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mix_of_nothing(spark, nothing, odd):
    assert mixed(nothing).collect() == [] and repeated_by_mix(nothing).collect() == []
    empty = odd.where("doc_id in (20, 21, 22)")
    assert [r.taken for r in mixed(empty).collect()] == [0, 0, 0]


def test_better_documents_are_taken_more_often(spark):
    rich = [(i, " ".join(f"w{i}x{k}" for k in range(20)), "a") for i in range(300)]
    poor = [(1000 + i, "same word " * 10, "a") for i in range(300)]
    docs = spark.createDataFrame(rich + poor, "doc_id long, text string, source string")
    got = mixed(docs, share=0.5, most=1.0).collect()
    assert sum(r.taken for r in got if r.doc_id < 1000) > 2 * sum(r.taken for r in got if r.doc_id >= 1000)


def test_rows_of_the_mix(odd):
    copies = {(r.doc_id, r.text_hash): r.copies for r in mixed(odd.where("doc_id < 30")).collect()}
    rows = repeated_by_mix(odd.where("doc_id < 30"))
    assert rows.columns == odd.columns
    count = defaultdict(int)
    for r in rows.collect():
        count[r.doc_id] += 1
    assert dict(count) == {i: n for (i, _), n in copies.items() if n}


@pytest.mark.parametrize("weights", [None, {"src0": 5.0, "src1": 1.0, "src2": 0.5}])
def test_packing_round_trip(spark, odd, weights):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (odd, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = docs.where("doc_id is not null and doc_id not in (40, 41)").collect() if docs is odd else docs.collect()
        frame = spark.createDataFrame(rows, docs.schema).repartition(4)
        ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in packed(frame, weights=weights).collect():
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        assert pieces.keys() == ids.keys()
        for i, found in pieces.items():
            at = 0
            for r in sorted(found, key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids[i])) and r.length > 0
                assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids[i])
        last = max(sequences)
        assert sorted(sequences) == list(range(last + 1))
        for k, found in sequences.items():
            at = 0
            for r in sorted(found, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at == 2048 or k == last and 0 < at < 2048


def test_deficits_stay_small():
    tokens = [100_003, 7, 33_331, 1, 5_000]
    schedule, share = Schedule(tokens, None, 64), np.array(tokens) / sum(tokens)
    given = np.zeros((sum(tokens) // 64 + 1, len(tokens)))
    for j, n in enumerate(tokens):
        for _, size, window, _ in schedule.pieces(j, 0, n):
            given[window, j] += size
    windows = np.minimum((np.arange(len(given)) + 1) * 64, sum(tokens))[:, None]
    assert np.abs(given.cumsum(0) - windows * share).max() < 1 + np.log2(len(tokens))
    assert (given[:-1].sum(1) == 64).all()


def test_other_targets_hold_until_a_queue_is_empty():
    schedule = Schedule([1000, 3000, 50], [1.0, 1.0, 0.0], 100)
    given = np.zeros((41, 3))
    for j, n in enumerate([1000, 3000, 50]):
        for _, size, window, _ in schedule.pieces(j, 0, n):
            given[window, j] += size
    assert np.abs(given[:20, 0] - 50).max() <= 1 and given[20:, 0].sum() == 0 and given[-1, 2] == 50


def test_encoder_is_the_tokenizer(odd_rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    use = Encoder("byte_bpe_50k")
    texts = [r[1] for r in odd_rows if r[1]] + ["<|endoftext|> a", "  \n\n x's 12", " " * 30_000 + "x", "y" * 12_000]
    assert all(use.ids(t) == tokenizer.encode(t, add_special_tokens=False).ids for t in texts)


def test_packing_nothing(nothing):
    assert packed(nothing).collect() == []


def test_which_texts_need_the_slow_tokenizer():
    """A special token's string anywhere, or a run of 10,000; shorter texts are not searched for runs."""
    use = Encoder("byte_bpe_50k")
    (special,) = use.special
    assert use.careful(f"a {special} b") and use.careful("x" * 10000) and use.careful("a " + " " * 10000) and use.careful("b " * 6000 + "y" * 10000)
    assert not use.careful("") and not use.careful("x" * 9999) and not use.careful("ab " * 5000) and not use.careful(special[:-1])
