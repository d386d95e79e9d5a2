"""Spans against the plain patterns, and disclosure by hand."""

import hashlib
import random
import re

import pytest

from trackside.llm.sanitise import KINDS, base_spans, personal_data, sanitised

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SF = "/root/testdata/sf0.01"


def digits(text):
    return re.sub("[^0-9]", "", text)


def checks(number):
    turned = [int(d) for d in reversed(number)]
    return sum(turned[0::2] + [sum(divmod(2 * d, 10)) for d in turned[1::2]]) % 10 == 0


def plain(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and checks(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(found)


@pytest.mark.parametrize("letters", ["ab1 2.3@@..-+5é()9", "0123456789 -", "12.", "a@.-b"])
def test_patterns(letters):
    rnd = random.Random(len(letters))
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_no_time():
    assert base_spans("a" * 300_000 + "@" + "b" * 300_000) == []
    assert base_spans("1" * 300_000 + ".2" * 100_000 + " +1" + "(" * 100_000) is not None


def listed(text):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in plain(text))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        found = got[r.doc_id]
        assert found.base_sha256 == hashlib.sha256(listed(r.text).encode()).hexdigest()
        assert (found.n_email, found.n_ip, found.n_card, found.n_phone) == tuple(sum(k == x for _, k, _ in plain(r.text)) for x in range(4))
        assert set(filter(None, listed(r.text).split(","))) <= set(found.spans.split(","))


def test_odd_rows(odd, odd_rows, nothing):
    got = personal_data(odd).collect()
    assert len(got) == len(odd_rows)
    (r,) = [r for r in got if r.doc_id == 61]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert personal_data(nothing).collect() == [] and sanitised(nothing).collect() == []
    clean = sanitised(odd)
    assert clean.columns == odd.columns and clean.count() == len(odd_rows)
    assert clean.where("doc_id = 61").first().text == "mail <email> or <phone>, <ip> and <card>"
    kept = {(r[0], r[1]) for r in odd_rows if r[0] != 61}
    assert {(r.doc_id, r.text) for r in clean.where("doc_id is null or doc_id <> 61").collect()} == kept


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} says Zorblat writes from secret@mail.example.com on day{i} and rest") for i in range(5)]
    rows += [(10 + i, f"note {i} says and rest of it, number {i}") for i in range(40)]
    rows += [(60 + i, "same words Copied always stand by other@mail.example.com here") for i in range(9)]  # copies: one context
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data(docs).collect()}
    assert "general:12:19" in got[0] and "general:20:26" in got[0]  # Zorblat, writes
    assert "general:7:11" not in got[0]  # says is everywhere
    assert got[60] == got[68] and "general" not in got[60]
    assert got[10] == ""
    text = {r.doc_id: r.text for r in sanitised(docs).collect()}
    assert "Zorblat" not in text[0] and "<name> <word>" in text[0] and text[10] == rows[5][1]
    strict = {r.doc_id: r.spans for r in personal_data(docs, support=6).collect()}
    assert "general" not in strict[0]


def test_entity_of_one_document(spark):
    """Most entities are written once: their terms are measured too, from below."""
    rows = [(0, "Note says Zorblat writes from secret@mail.example.com on and rest")]
    rows += [(1 + i, f"Note says writes from on and rest number {i}") for i in range(1000)]
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "general:10:17,email:30:53"
    assert set(got.values()) == {got[0], ""}
    few = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows[:20], "doc_id long, text string")).collect()}
    assert "general" not in few[0]  # too few documents to tell


def test_terms_far_from_the_entity(spark):
    """Eight words away, and where the entity itself is not written."""
    rows = [(i, f"Note {10 + i} Zorblat says one two three four five six seven by secret@mail.example.com") for i in range(3)]
    rows += [(3, "Note of Zorblat ZORBLAT says é seven")]
    rows += [(10 + i, f"Note {10 + i} Says one two three four five six seven by") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data(docs).collect()}
    assert all(got[i] == "general:8:15,email:58:81" for i in range(3))
    assert got[3] == "general:8:15,general:16:23" and not any(got[10 + i] for i in range(200))
    assert {r.text for r in sanitised(docs).where("doc_id = 3").collect()} == {"Note of <name> <name> says é seven"}


def test_copies_hide_nothing(spark):
    """Copies of one of the entity's documents change no other row."""
    rows = [(i, f"Note {10 + i} Zorblat says one by secret@mail.example.com") for i in range(3)]
    rows += [(10 + i, f"Note {10 + i} Says one by") for i in range(200)]
    copies = [(1000 + i, rows[0][1]) for i in range(1000)]
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "general:8:15,email:28:51"
    more = personal_data(spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(5)).collect()
    assert len(more) == len(rows) + 1000
    assert {r.doc_id: r.spans for r in more} == got | {i: got[0] for i, _ in copies}
