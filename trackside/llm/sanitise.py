"""Personal data and the terms that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers by fixed patterns (:func:`base_spans`). Each
distinct value is a protected entity. Each term (a word outside base spans, A-Z lower-cased) of a document with an
entity is measured by how much it tells about it: with document shares p, PMI(e, t) = log2(p(e, t) / (p(e) p(t))) against
the entity's own information IC(e) = log2(1 / p(e)). Shares are taken as if ``UNSEEN`` more documents had the entity
without the term and as many the term without the entity, which bounds PMI from below where counts are small: every
pair is measured, those seen once too (``support`` can ask for more documents). A term that has PMI >= ``DISCLOSURE`` * IC
discloses the entity. It is generalised to its class (number, capitalised word, other word) unless the class itself
discloses the entity; then it is removed. Such terms are marked wherever they stand, also in documents without the entity.

Counts cover all documents: entities and pairs from those with base spans; p(t) from every document that has one of their
terms, which a bitmap of fixed size picks out before the shuffle. PMI is at most log2(1 / p(t)), so terms of more documents
than any entity allows are left out of the pairs. All counts are of different texts, so copies of a document neither
support one another nor make their terms look common.

Null text counts as empty; null ids are kept; repeated rows are judged alike. Offsets are code points, ends
exclusive. Extra columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside.llm.anchors import LAST_ID, keyed
from trackside.llm.common import batch, in_arrow, may_contain, prepare, signed, stored, unused
from trackside.llm.textscan import chunks, encoded, mix, scan_words

SUPPORT = 1
UNSEEN = 2
DISCLOSURE = 0.8
FILTER_BITS = 26
KINDS = ("email", "ip", "card", "phone", "general", "removed")
CLASSES = ("<word>", "<name>", "<number>")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_IS_DIGIT = np.zeros(256, np.int32)
_IS_DIGIT[ord("0") : ord("9") + 1] = 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards, so that long runs of letters cost nothing."""
    found, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            after = domain.end()
        at = text.find("@", max(at + 1, after))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Groups of four in each maximal run of numbers joined by dots."""
    found = []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, parts = run.start(), run.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, at + size))
            at += size + 1
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity_of(kind: int, value: str) -> str:
    return f"{kind}:{value.lower() if kind < 2 else _NO_DIGIT.sub('', value)}"


def word_classes(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Index into CLASSES of each word."""
    if not len(begin):
        return np.zeros(0, np.int64)
    number = np.add.reduceat(_IS_DIGIT[raw], begin) > 0
    first = raw[begin]
    return np.where(number, 2, np.where((first >= 65) & (first <= 90), 1, 0))


def class_key(n: int) -> int:
    return int(mix(np.array([0xC1A55 + n], np.uint64)).view(np.int64)[0])


CLASS_KEYS = [class_key(n) for n in range(len(CLASSES))]


def free_words(texts: list[bytes], spans: list[list[tuple]]) -> tuple[np.ndarray, ...]:
    """Text, hash, class, begin and end (code points) of each word outside its text's base spans."""
    words = scan_words(texts, lower=True)
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    at = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=at[1:])
    origin, begin, end, owner = points[at], points[words.begin], points[words.end], words.owner
    kind = word_classes(raw, words.begin)
    inside = np.zeros(points[-1] + 2, np.int64)
    for i, found in enumerate(spans):
        for a, _, b in found:
            inside[origin[i] + a] += 1
            inside[origin[i] + b] -= 1
    touched = np.concatenate([[0], np.cumsum(np.cumsum(inside) > 0)])
    free = touched[end] == touched[begin]
    owner, begin, end = owner[free], begin[free], end[free]
    return owner, words.hashes[free], kind[free], begin - origin[owner], end - origin[owner]


def distinct_terms(owner: np.ndarray, hashes: np.ndarray, kind: np.ndarray, keep=slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) once each, by text: the words in ``keep`` and the classes of all words."""
    doc = np.concatenate([owner[keep], owner])
    term = np.concatenate([signed(hashes[keep]), np.array(CLASS_KEYS, np.int64)[kind]])
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new]


SPAN = "struct<start:long,kind:int,stop:long>"


def examined(rows: DataFrame) -> DataFrame:
    """did, th and base spans; of texts with base spans the entities and the terms, once each."""

    def run(batches):
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
        for b in batches:
            texts = b.column(2).to_pylist()
            base = [base_spans(t) for t in texts]
            held = [i for i, s in enumerate(base) if s]
            entities, terms = [[] for _ in texts], [[] for _ in texts]
            for i in held:
                names = {entity_of(k, texts[i][a:e]).replace(" ", "_") for a, k, e in base[i]}
                entities[i] = np.unique(signed(scan_words(encoded(names)).hashes))
            raw = encoded(texts[i] for i in held)
            for i, j in chunks(raw):
                doc, term = distinct_terms(*free_words(raw[i:j], [base[k] for k in held[i:j]])[:3])
                for k, part in zip(held[i:j], np.split(term, np.searchsorted(doc, np.arange(1, j - i)))):
                    terms[k] = part
            spans = [[dict(start=a, kind=k, stop=e) for a, k, e in s] for s in base]
            long = pa.list_(pa.int64())
            yield batch(
                did=b.column(0), th=b.column(1), base=pa.array(spans, span_type), entities=pa.array(entities, long), terms=pa.array(terms, long)
            )

    return in_arrow(rows, run, f"did long, th long, base array<{SPAN}>, entities array<long>, terms array<long>")


def filter_of(terms: DataFrame):
    """A function that is true for the hashes in ``terms``, and rarely for others: two cells each of a bitmap of
    fixed size (FILTER_BITS). What passes by chance is dropped by the joins."""
    cell = F.explode(F.array(F.shiftrightunsigned("term", 64 - FILTER_BITS), F.col("term").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))))
    cells = terms.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("at"))
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in cells.agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")).toLocalIterator():
        bitmap[r["at"]] = r["bits"]  # 2 ** (FILTER_BITS - 6) rows at most
    shared = terms.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def hit(hashes: np.ndarray) -> np.ndarray:
        def bit(at):
            return shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))

        return bit(hashes >> np.uint64(64 - FILTER_BITS)) & bit(hashes & np.uint64((1 << FILTER_BITS) - 1)) & np.uint64(1) > 0

    return hit


def scanned(texts: list[str]):
    """First text and free words of each chunk."""
    raw = encoded(texts)
    for i, j in chunks(raw):
        yield i, free_words(raw[i:j], [base_spans(t) for t in texts[i:j]])


def document_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_t): texts with each of ``terms`` (and with each class of words), over all rows. Others may be among them."""
    hit = filter_of(terms)

    def count(batches):
        for b in batches:
            for _, (owner, hashes, kind, _, _) in scanned(b.column(0).to_pylist()):
                term, n = np.unique(distinct_terms(owner, hashes, kind, hit(hashes))[1], return_counts=True)
                if len(term):
                    yield batch(term=term, n=n)

    return in_arrow(rows.select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def one_per_text(rows: DataFrame, found: DataFrame) -> DataFrame:
    """text of ``rows``, equal texts once. Only those that are, or may be, repeated are shuffled."""
    repeated = stored(found.groupBy("th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("th"), "repeated")
    hit = may_contain(repeated)("th")
    once = rows.where(hit).select("th", "text").dropDuplicates(["th"])
    return rows.where(~hit).select("text").unionByName(once.select("text"))


def disclosing(found: DataFrame, rows: DataFrame, n_docs: int, support: int, disclosure: float) -> DataFrame:
    """(term, told): terms that disclose an entity; bit i of ``told`` is set if class i discloses one of the same entities."""
    private = found.where(F.size("entities") > 0).select("th", "entities", "terms").dropDuplicates(["th"])
    private = stored(private, "private")
    seen = private.select("th", F.explode("entities").alias("entity"))
    alone = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64("th")).alias("where"))
    # Entities that stand in the same documents have the same terms: one group.
    groups = seen.join(alone, "entity").select("th", F.xxhash64("n_e", "where").alias("group"), "n_e").distinct()
    groups = stored(groups, "groups")

    total = F.lit(n_docs + 2.0 * UNSEEN)
    own = F.log2(total / (F.col("n_e") + UNSEEN))
    # n_et is at most n_e, so terms of more documents than this disclose nothing.
    most = total * F.col("n_e") / (F.col("n_e") + UNSEEN) / F.pow(F.lit(2.0), disclosure * own) * (1 + 1e-9) - UNSEEN
    limit = groups.agg(F.max(most)).first()[0] or 0.0
    counts = document_counts(rows, private.select(F.explode("terms").alias("term")).distinct())
    counts = stored(counts.where(F.col("n_t") <= limit), "counts")
    rare = filter_of(counts)
    passes = F.pandas_udf(lambda term: pd.Series(rare(term.to_numpy(np.int64).view(np.uint64))), "boolean")
    terms = private.select("th", F.explode("terms").alias("term")).where(passes("term"))
    pairs = terms.join(counts, "term").join(groups, "th").where(F.col("n_t") <= most)
    together = pairs.groupBy("group", "n_e", "term", "n_t").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    pmi = F.log2(total * F.col("n_et") / ((F.col("n_e") + UNSEEN) * (F.col("n_t") + UNSEEN)))
    over = stored(together.where(pmi >= disclosure * own).select("group", "term"), "over")
    is_class = F.col("term").isin(CLASS_KEYS)
    bit = F.lit(0)
    for i, key in enumerate(CLASS_KEYS):
        bit = F.when(F.col("term") == key, 1 << i).otherwise(bit)
    told = over.where(is_class).groupBy("group").agg(F.bit_or(bit).alias("told"))
    words = over.where(~is_class).join(told, "group", "left")
    return stored(words.groupBy("term").agg(F.bit_or(F.coalesce("told", F.lit(0))).alias("told")), "disclosing")


def marked(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """did, th and more: spans of disclosing terms, wherever they stand."""
    hit = filter_of(terms)

    def run(batches):
        for b in batches:
            did, th = (np.asarray(b.column(i), np.int64) for i in (0, 1))
            for i, (owner, hashes, kind, begin, end) in scanned(b.column(2).to_pylist()):
                at = np.flatnonzero(hit(hashes))
                doc = i + owner[at]
                if len(at):
                    yield batch(did=did[doc], th=th[doc], term=signed(hashes[at]), sort=kind[at].astype(np.int32), start=begin[at], stop=end[at])

    places = in_arrow(rows, run, "did long, th long, term long, sort int, start long, stop long").join(terms, "term")
    kind = F.when(F.expr("shiftright(told, sort) & 1") == 1, KINDS.index("removed")).otherwise(KINDS.index("general"))
    # A set, as rows may be repeated.
    return places.groupBy("did", "th").agg(F.collect_set(F.struct("start", kind.alias("kind"), "stop")).alias("more"))


def personal_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: int = SUPPORT,
    disclosure: float = DISCLOSURE,
) -> DataFrame:
    """did, th, base and spans (arrays of start, kind, stop; kinds index ``KINDS``) for every row."""
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    found = stored(examined(rows), "personal")
    texts = found.select("th").distinct().count()
    terms = disclosing(found, one_per_text(rows, found), texts, support, disclosure)
    found = found.select("did", "th", "base").join(marked(rows, terms), ["did", "th"], "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))))
    return found.select("did", "th", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = personal_spans(docs, id_col, text_col, **options)

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [number(kind) for kind in range(4)]
    return found.select(
        F.when(F.col("did") != LAST_ID, F.col("did")).alias(id_col), *counts,
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each base span replaced by its kind, disclosing terms by their class or by nothing."""
    columns = docs.columns
    did, th, found = unused(docs, "did", "th", "found")
    spans = personal_spans(docs, id_col, text_col, **options).where(F.size("spans") > 0).dropDuplicates(["did", "th"])
    spans = stored(spans.select(F.col("did").alias(did), F.col("th").alias(th), F.col("spans").alias(found)), "spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(did, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))).withColumn(th, F.xxhash64(text))
    # Only rows that may have spans are shuffled with their texts.
    hit = may_contain(spans.select(did))(did)
    touched = rows.where(hit).join(spans.hint("shuffle_hash"), [did, th], "left")

    @F.pandas_udf("string")
    def replaced(texts, spans):
        out = []
        for text, found in zip(texts, spans):
            if found is not None:
                parts, at = [], 0
                for s in found:
                    if s["start"] >= at:
                        word = text[s["start"] : s["stop"]]
                        kind = KINDS[s["kind"]]
                        if kind == "general":
                            raw = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)
                            kind = CLASSES[int(word_classes(raw, np.zeros(1, np.int64))[0])][1:-1]
                        parts += [text[at : s["start"]], "" if kind == "removed" else f"<{kind}>"]
                    at = max(at, s["stop"])
                text = "".join(parts) + text[at:]
            out.append(text)
        return type(texts)(out, dtype=object)

    cleaned = F.when(F.col(found).isNotNull(), replaced(text, F.col(found))).otherwise(F.col(text_col))
    return rows.where(~hit).select(*columns).unionByName(touched.withColumn(text_col, cleaned).select(*columns))
