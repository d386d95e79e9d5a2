"""Document fingerprints by I-Match with randomised lexicons.

Terms are words (runs other than space and 0x09-0x0D, A-Z lower-cased). The lexicon holds the terms whose document share
df / N lies in (``LEAST``, ``MOST``], a band of inverse document frequency, counted over all documents. Its size is bounded by
(distinct terms in a document, on average) / ``LEAST``, whatever the number of documents, so it may be broadcast.

A fingerprint has one part per sub-lexicon: the whole lexicon, and random halves, quarters, ... of it (``RATES``). A
part hashes the sorted distinct terms of the document that are in the sub-lexicon; it is empty if there are none. The
likeness of two fingerprints is the share of equal parts among those that are not empty in both. If a text has no
term of the lexicon, all its terms are used instead, and a text without words has one fixed
fingerprint; two equal fingerprints always have likeness 1.

The edited text of a document takes its last floor(n/4) code points from the beginning of the next document, by
ascending id. Rows are dealt to ranges of ids (cut at approximate quantiles), each with the first row after the range; texts
are compressed for that one shuffle.

Null text counts as empty. Null ids come last. Rows with equal ids are ordered by text. A single row is
its own next document. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.llm.anchors import LAST_ID
from trackside.llm.common import batch, prepare, signed, unsigned
from trackside.llm.textscan import chunks, encoded, mix, scan_words

LEAST = 0.001
MOST = 0.05
RATES = (1.0, *(r for r in (1 / 8, 1 / 16, 1 / 32, 1 / 64, 1 / 128, 1 / 256, 1 / 512) for _ in range(8)))
SEED = 11
PART_HEX = 4
EMPTY = "0" * PART_HEX
ROWS_PER_RANGE = 20_000
MOST_RANGES = 4096  # then ranges grow; rows of a range are sorted by Spark and streamed
TERMS_PER_FLUSH = 1_000_000


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, df) over all rows of ``texts`` (column 0)."""

    def count(batches):
        held, size = [], 0
        for b in batches:
            part = encoded(b.column(0).to_pylist())
            for i, j in chunks(part):
                words = scan_words(part[i:j], lower=True)
                order = np.lexsort((words.owner, words.hashes))
                term, doc = words.hashes[order], words.owner[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
                held.append(np.unique(term[new], return_counts=True))
                size += len(held[-1][0])
            if size > TERMS_PER_FLUSH:
                held = [merged(held)]
                if len(held[0][0]) > TERMS_PER_FLUSH:
                    yield batch(term=signed(held[0][0]), n=held[0][1])
                    held = []
                size = sum(len(t) for t, _ in held)
        if held:
            term, n = merged(held)
            yield batch(term=signed(term), n=n)

    def merged(held):
        term = np.concatenate([t for t, _ in held])
        order = np.argsort(term, kind="stable")
        term, n = term[order], np.concatenate([n for _, n in held])[order]
        if not len(term):
            return term, n
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        return term[first], np.add.reduceat(n, first)

    return texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


class Lexicon:
    """Sorted terms and, for each, the sub-lexicons it is in (one bit each)."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        self.member = np.zeros((len(terms), len(RATES)), bool)
        for k, rate in enumerate(RATES):
            draw = mix(self.terms ^ np.uint64(((SEED << 32) + k) * 0x9E3779B97F4A7C15 % (1 << 64)))
            self.member[:, k] = draw < np.uint64(min(int(rate * 2.0**64), (1 << 64) - 1))

    def fingerprints(self, texts: list[bytes]) -> list[str]:
        out = []
        for i, j in chunks(texts):
            words = scan_words(texts[i:j], lower=True)
            for a, b in zip(words.first[:-1], words.first[1:]):
                distinct = np.unique(words.hashes[a:b])
                at = np.minimum(np.searchsorted(self.terms, distinct), max(len(self.terms) - 1, 0))
                known = self.terms[at] == distinct if len(self.terms) else np.zeros(len(distinct), bool)
                if known.any():
                    kept, member = distinct[known], self.member[at[known]]
                    parts = [self.part(kept[member[:, k]]) for k in range(len(RATES))]
                else:
                    parts = [self.part(distinct)] * len(RATES)
                out.append("".join(parts))
        return out

    @staticmethod
    def part(terms: np.ndarray) -> str:
        if not len(terms):
            return EMPTY
        found = int.from_bytes(hashlib.blake2b(terms.tobytes(), digest_size=8).digest(), "big")
        return f"{found % (16**PART_HEX - 1) + 1:0{PART_HEX}x}"


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    pairs = [(a[k : k + PART_HEX], b[k : k + PART_HEX]) for k in range(0, len(a), PART_HEX)]
    told = [x == y for x, y in pairs if x != EMPTY or y != EMPTY]
    return sum(told) / len(told) if told else 1.0


def lexicon(texts: DataFrame, least: float = LEAST, most: float = MOST) -> Lexicon:
    n = texts.count()
    band = document_frequencies(texts).where((F.col("df") > least * n) & (F.col("df") <= most * n)).select("term")
    found = [unsigned(np.array([r.term for r in band.toLocalIterator()], np.int64))]
    return Lexicon(found[0])


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("did"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    shared = spark.sparkContext.broadcast(lexicon(rows.select("text")))

    # Ranges of ids, and the first id of each range that has rows: one number per range.
    total = rows.count()
    ranges = min(max(1, total // ROWS_PER_RANGE), MOST_RANGES)
    cuts = sorted(set(rows.approxQuantile("did", [k / ranges for k in range(1, ranges)], 0.05 / ranges))) if ranges > 1 else []
    cuts = [int(c) for c in cuts]
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    # How many cuts lie at or below the id, by halving.
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    number = F.lit(0)
    if cuts:
        number = F.aggregate(
            F.array(*map(F.lit, steps)), F.lit(0),
            lambda at, step: at + F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= F.col("did")), step).otherwise(0),
        )
    rows = rows.withColumn("range", number)
    firsts = {r.range: (r.did, r.th) for r in rows.groupBy("range").agg(F.min(F.struct("did", F.xxhash64("text").alias("th"))).alias("m")).select("range", "m.*").collect()}
    there = sorted(firsts)
    previous = {r: there[k - 1] for k, r in enumerate(there)}  # the first range's rows follow the last range

    def described(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = encoded(b.column(1).to_pylist())
            prints = shared.value.fingerprints(texts)
            small = [pack.compress(t) for t in texts]
            did, where, th = (b.column(k) for k in (0, 2, 3))
            yield batch(range=where, did=did, th=th, guest=pa.array([False] * len(texts)), fingerprint=prints, text=pa.array(small, pa.binary()))
            for k, (d, r, h) in enumerate(zip(did.to_pylist(), where.to_pylist(), th.to_pylist())):
                if firsts[r] == (d, h):
                    yield batch(
                        range=pa.array([previous[r]], pa.int32()), did=[d], th=[h], guest=[True], fingerprint=[prints[k]], text=pa.array([small[k]], pa.binary())
                    )

    def edited(batches):
        unpack = zstandard.ZstdDecompressor()
        held = None
        guests: list[tuple] = []

        def finish(rows):
            """(did, text, print, next text, next print) rows to output columns."""
            sources, changed = [], []
            for did, text, own, after, _ in rows:
                cut = len(text) // 4
                changed.append(text[: len(text) - cut] + after[:cut])
                sources.append((did, len(text), own))
            raw = encoded(changed)
            prints = shared.value.fingerprints(raw)
            return batch(
                did=pa.array([s[0] for s in sources], pa.int64()), n_chars=pa.array([s[1] for s in sources], pa.int64()),
                edited_sha256=[hashlib.sha256(t).hexdigest() for t in raw],
                fingerprint=[s[2] for s in sources], edited_fingerprint=prints,
                near_edited=[likeness(s[2], p) for s, p in zip(sources, prints)],
                near_next=[likeness(r[2], r[4]) for r in rows],
            )

        now = None
        for b in batches:
            rows = []
            for r, guest, did, small, own in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4, 5))):
                text = unpack.decompress(small).decode("utf-8", "surrogatepass")
                if r != now:
                    if held is not None:
                        rows.append((*held, *guests[0]))
                    now, held, guests = r, None, []
                if guest:  # sorted first; the row after this range
                    guests.append((text, own))
                    continue
                if held is not None:
                    rows.append((*held, text, own))
                held = (did, text, own)
            if rows:
                yield finish(rows)
        if held is not None:
            yield finish([(*held, *guests[0])])

    sent = rows.select("did", "text", "range", F.xxhash64("text").alias("th")).mapInArrow(
        described, "range int, did long, th long, guest boolean, fingerprint string, text binary"
    )
    dealt = sent.repartition("range").sortWithinPartitions("range", F.desc("guest"), "did", "th")
    schema = (
        "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    out = dealt.select("range", "guest", "did", "th", "text", "fingerprint").mapInArrow(edited, schema)
    return out.withColumn("did", F.when(F.col("did") != LAST_ID, F.col("did"))).withColumnRenamed("did", id_col)
