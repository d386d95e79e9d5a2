"""Pieces, offsets and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from trackside.llm.pieces import Normaliser, Pieces, digests, fields, in_pieces, public_model

PARTS = ["a", "b", " ", "  ", "\n", "é", "日本", "▁", "x" * 300, "the", "😀", "\x00", "<s>", "<0x41>", "\t", "ing", " t", "ß", "."]
WIDE = ["Ａ", "ﬁ", "㍿", "　", "①", "ｶﾞ", "​", "İ", "Σ", "é"]


def random_texts(n, parts, most=60):
    rnd = random.Random(n)
    return ["".join(rnd.choices(parts, k=rnd.randint(0, most))) for _ in range(n)]


def with_rule(rule):
    """The public model with another character map; nothing is trained."""
    with open(public_model(), "rb") as file:
        model = file.read()
    spec = dict(fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    head, size = b"\x1a", len(spec)
    while True:
        head += bytes([size & 127 | (128 if size > 127 else 0)])
        size >>= 7
        if not size:
            return model + head + spec, spec


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf"])
def test_same_as_the_library(rule):
    model = with_rule(rule)[0] if rule else open(public_model(), "rb").read()
    own, lib = Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = random_texts(400, PARTS + (WIDE if rule else [])) + ["", " ", "x" * 5000, "日本" * 500, "\n\n \n"]
    for text, (ids, spans) in zip(texts, own.encode([t.encode() for t in texts])):
        want = [1, *lib.encode(text), 2]
        assert ids.tolist() == want, text
        assert own.decode(ids) == lib.decode(want), text
        assert (spans[:, 0] <= spans[:, 1]).all() and (spans[1:, 0] >= spans[:-1, 1]).all()
        if rule is None and text:  # nothing is deleted: the spans tile the text
            assert spans[1, 0] == 0 and spans[-2, 1] == len(text.encode()) and (spans[2:-1, 0] == spans[1:-2, 1]).all()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf"])
def test_alignment_is_the_librarys(rule):
    lib, own = sentencepiece.SentencePieceNormalizer(rule_name=rule), Normaliser(with_rule(rule)[1])
    for text in random_texts(800, [p for p in PARTS if len(p) < 50] + WIDE, 20):
        want, offsets = lib.normalize(text, with_offsets=True)
        got, align = own(text.encode())
        assert got.decode() == want
        places = np.concatenate([[0], np.cumsum([len(c.encode()) for c in want])]).astype(int)
        if want:
            assert [len(text.encode()[:o].decode("utf-8", "ignore")) for o in align[places]] == offsets


def test_spans_hold_the_pieces_text():
    own, text = Pieces(open(public_model(), "rb").read()), "Über  the 日本 line\nand 😀 on"
    ((ids, spans),) = own.encode([text.encode()])
    for i, (a, b) in list(zip(ids.tolist(), spans.tolist()))[2:-1]:
        assert text.encode()[a:b] == own.surface[i]
    mapped, lib = Pieces(with_rule("nmt_nfkc")[0]), "  ﬁx  ＡＢ"
    ((ids, spans),) = mapped.encode([lib.encode()])
    covered = [lib.encode()[a:b].decode() for a, b in spans.tolist()]
    assert "".join(covered).replace(" ", "") == "ﬁxＡＢ"


def test_decoding_any_ids():
    own, lib = Pieces(open(public_model(), "rb").read()), sentencepiece.SentencePieceProcessor(model_file=public_model())
    rnd = random.Random(3)
    for _ in range(2000):
        ids = [rnd.choice([0, 1, 2, 230, 132, 133, 258, 68, 259, 260, 300, rnd.randrange(32000)]) for _ in range(rnd.randint(0, 8))]
        assert own.decode(np.array(ids, "<u4")) == lib.decode(ids), ids


def test_bytes_that_are_no_text():
    own = Pieces(open(public_model(), "rb").read())
    ((ids, spans),) = own.encode([b"a\xff\xfeb"])
    assert own.decode(ids) == "a��b" and spans[-2].tolist() == [3, 4]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr("trackside.llm.pieces.REMEMBERED", 50)
    own, lib = Pieces(open(public_model(), "rb").read()), sentencepiece.SentencePieceProcessor(model_file=public_model())
    for k in range(20):
        text = " ".join(random_texts(30 + k, ["ab", "th", "e", "ö"], 5))
        ((ids, _),) = own.encode([text.encode()])
        assert ids.tolist() == [1, *lib.encode(text), 2] and len(own.known) <= 50


def test_odd_rows(spark, odd, odd_rows, nothing):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_model())

    def wanted(doc_id, text):
        ids = [1, *lib.encode(text or ""), 2]
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        return doc_id, len(ids), sha, hashlib.sha256(lib.decode(ids).encode()).hexdigest()

    got = [tuple(r)[:4] for r in digests(in_pieces(odd)).collect()]
    assert sorted(got, key=str) == sorted((wanted(r[0], r[1]) for r in odd_rows), key=str)
    assert digests(in_pieces(nothing)).collect() == []
