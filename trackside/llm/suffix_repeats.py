"""Byte-level de-duplication with suffix arrays and the tree of their common-prefix intervals.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a document of smaller id, or earlier
in the same document) is removed.

1. Suffixes that share ``length`` bytes share an anchor (:mod:`anchors`), so suffixes are dealt to tasks by anchor,
   leaving out anchors that a count-min sketch proves single. A run of suffixes with one anchor is one row with
   the bytes they need; equal rows are sent once per flush, and anchors found very frequently are dealt by their first
   ``length`` bytes instead, so that no bucket holds a fixed share of the input.
2. A task sorts the suffixes of its buckets: by anchor and first ``length`` bytes (compared by 64-bit hash each; bytes
   beyond that are compared as they are). Distinct runs are in the array once, with all their occurrences.
3. A scan with a stack over the common prefixes of neighbours builds the interval tree. An interval whose suffixes
   are preceded by different bytes (or by the start of a run) is a maximal repeat, with all occurrences in it; those
   but the earliest go, in full length. Repeats that all extend to the left are part of a longer one and are skipped.

Null text counts as empty, null id as the largest. Rows with equal ids and texts get equal results and are not earlier
than one another. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.llm import sketch as cms
from trackside.llm.anchors import LAST_ID, Scan, Shape, candidates, covered, keyed, keys_of, spread, with_spans
from trackside.llm.common import batch, joined, prepare, unsigned
from trackside.llm.textscan import byte_weights, encoded, gram_hashes, mix

LENGTH = 100
ANCHOR = 32
WIDTH_BITS = 27
HOT = 2000
PIECE_BYTES = 2 << 20  # a task sorts the suffixes of so many bytes of its buckets at a time


def scan_bytes(window: int, anchor: int, texts: list[bytes]) -> Scan:
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    origin = np.cumsum(size) - size
    starts = np.maximum(size - window + 1, 0)
    weights = byte_weights(data)
    return Scan(
        gram_hashes(weights, anchor), gram_hashes(weights, window), spread(origin, starts),
        np.repeat(np.arange(len(texts)), starts), origin, data,
    )


def intervals(suffixes: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of sorted suffixes, all of which share ``least`` bytes.

    The tree is walked bottom-up: an interval is closed when a shorter common prefix follows.
    """
    found, stack = [], [(least, 0)]
    for i in range(1, len(suffixes) + 1):
        common = -1
        if i < len(suffixes):
            a, b = suffixes[i - 1], suffixes[i]
            common = min(len(a), len(b))
            if a[:common] != b[:common]:
                x, y = np.frombuffer(a, np.uint8, common), np.frombuffer(b, np.uint8, common)
                common = int(np.argmax(x != y))
            common += least
        left = i - 1
        while stack and stack[-1][0] > common:
            depth, left = stack.pop()
            found.append((depth, left, i - 1))
        if i < len(suffixes) and (not stack or stack[-1][0] < common):
            stack.append((common, left))
    return [x for x in found if x[1] < x[2]]


def maximal_repeats(key, head, tail, did, th, start, size, data, length):
    """Spans (did, th, start, stop) that go, among the runs of one task.

    ``data`` holds the runs' bytes one after the other, ``size + length - 1`` each.
    """
    bytes_of = size + length - 1
    at = np.cumsum(bytes_of) - bytes_of
    order = np.lexsort((start, did, size, tail, head, key))
    a, b = order[1:], order[:-1]
    same = np.zeros(len(key), bool)
    same[1:] = (key[a] == key[b]) & (head[a] == head[b]) & (tail[a] == tail[b]) & (size[a] == size[b])
    e = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))]
    later = same & ((did[order] != did[e]) | (start[order] != start[e]))
    gone = order[later]
    yield did[gone], th[gone], start[gone], start[gone] + bytes_of[gone]
    # Distinct runs, where a bucket has several.
    one = order[~same]
    several = np.zeros(len(one), bool)
    equal = key[one[1:]] == key[one[:-1]]
    several[1:] |= equal
    several[:-1] |= equal
    one = one[several]
    if not len(one):
        return
    suffix = spread(at[one], size[one])  # byte positions in ``data``
    run = np.repeat(one, size[one])
    prefix = gram_hashes(byte_weights(data), length)[suffix]
    order = np.lexsort((prefix, key[run]))
    suffix, run = suffix[order], run[order]
    new = np.ones(len(order), bool)
    new[1:] = (prefix[order[1:]] != prefix[order[:-1]]) | (key[run[1:]] != key[run[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    # 256: nothing known to the left, different from any byte
    before = np.where(suffix == at[run], np.int64(256), data[suffix - 1].astype(np.int64))
    low, high = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
    maximal = (count > 1) & ((low != high) | (high == 256))
    raw = data.tobytes()
    ends = at + bytes_of
    out = []
    for f, n in zip(first[maximal].tolist(), count[maximal].tolist()):
        members = range(f, f + n)
        rest = [raw[suffix[m] + length : ends[run[m]]] for m in members]
        ranked = sorted(range(n), key=rest.__getitem__)
        rows = run[f + np.array(ranked)]
        place = start[rows] + suffix[f + np.array(ranked)] - at[rows]
        ids, left = did[rows], before[f + np.array(ranked)]
        reach = np.zeros(n, np.int64)
        for depth, i, j in intervals([rest[k] for k in ranked], length):
            part = slice(i, j + 1)
            if left[part].max() < 256 and left[part].min() == left[part].max():
                continue
            earliest = np.lexsort((place[part], ids[part]))[0] + i
            other = (ids[part] != ids[earliest]) | (place[part] != place[earliest])
            reach[part] = np.where(other, np.maximum(reach[part], depth), reach[part])
        hit = np.flatnonzero(reach)
        out.append((ids[hit], th[rows[hit]], place[hit], place[hit] + reach[hit]))
    if out:
        yield tuple(np.concatenate(x) for x in zip(*out))


def repeat_spans(rows: DataFrame, length: int, anchor: int, width_bits: int, hot: int) -> DataFrame:
    """(did, th, start, stop) in bytes; spans of one document may overlap."""
    shape = Shape(partial(scan_bytes, length, anchor), length, anchor, length - 1)
    sketch = cms.build(rows.select("text"), keys_of(shape, 0), width_bits, hot)
    sent = candidates(rows, shape, rows.sparkSession.sparkContext.broadcast(sketch))

    def spans(did, th, start, stop):
        return batch(did=did, th=th, start=start.astype(np.int32), stop=stop.astype(np.int32))

    def grouped(batches):
        held = []
        for b in batches:
            known = np.asarray(b.column(5).is_null())
            did, th, start, n = (np.asarray(b.column(i)).astype(np.int64) for i in (1, 2, 3, 4))
            if known.any():
                yield spans(did[known], th[known], start[known], start[known] + n[known] + length - 1)
            if not known.all():
                data, _ = joined(b.column(5).filter(pa.array(~known)), np.uint8)
                key = unsigned(np.asarray(b.column(0)))
                held.append((key[~known], did[~known], th[~known], start[~known], n[~known], data))
        if held:
            key, did, th, start, n, data = (np.concatenate(x) for x in zip(*held))
            held.clear()
            at = np.cumsum(n + length - 1) - (n + length - 1)
            pieces = len(data) // PIECE_BYTES + 1
            piece = (mix(key) % np.uint64(pieces)).astype(np.int64)
            for p in range(pieces):  # whole buckets
                r = np.flatnonzero(piece == p)
                if len(r):
                    part = data[spread(at[r], n[r] + length - 1)]
                    ends = np.cumsum(n[r] + length - 1)
                    windows = gram_hashes(byte_weights(part), length)
                    head, tail = windows[ends - n[r] - length + 1], windows[ends - length]
                    for x in maximal_repeats(key[r], head, tail, did[r], th[r], start[r], n[r], part, length):
                        if len(x[0]):
                            yield spans(*x)

    return sent.repartition("key").mapInArrow(grouped, "did long, th long, start int, stop int")


def remove_repeated_strings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    width_bits: int = WIDTH_BITS,
    hot: int = HOT,
) -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, n_spans, kept (the remaining bytes; they may cut code points), kept_sha256."""
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    marked = with_spans(rows, repeat_spans(rows, length, anchor, width_bits, hot))

    def kept(batches):
        for b in batches:
            texts = encoded(b.column(1).to_pylist())
            removed, runs, left = [], [], []
            for i, text in enumerate(texts):
                out = covered(len(text), b.column(2)[i], b.column(3)[i])
                if out is not None:
                    left.append(np.frombuffer(text, np.uint8)[~out].tobytes())
                    runs.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                else:
                    left.append(text)
                    runs.append(0)
                removed.append(len(text) - len(left[-1]))
            yield batch(
                did=b.column(0), n_bytes=pa.array([len(t) for t in texts], pa.int64()),
                n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(runs, pa.int64()),
                kept=pa.array(left, pa.binary()), kept_sha256=[hashlib.sha256(t).hexdigest() for t in left],
            )

    schema = "did long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    out = marked.mapInArrow(kept, schema)
    return out.select(
        F.when(F.col("did") != LAST_ID, F.col("did")).alias(id_col),
        "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256",
    )
