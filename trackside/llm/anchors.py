"""Windows of a text grouped by anchors, and the rows that carry candidates for repeats.

A window's *anchor* is the run of ``anchor`` units in it with the smallest hash, the leftmost of equals. Equal
windows have equal anchors at equal distances, so windows with different anchors never need to be compared, and
consecutive windows that share an anchor travel as one *run*.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import batch, blobs, signed
from trackside.llm.sketch import Sketch
from trackside.llm.textscan import chunks, encoded, mix, window_argmin

RUNS_PER_FLUSH = 200_000
PAYLOAD_PER_FLUSH = 24 << 20
PAYLOAD_SLICE = 4 << 20
LAST_ID = (1 << 63) - 1
SENT = "key long, did long, th long, start int, n int, payload binary"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did (null: the largest), th (hash of the text: rows of equal id stay apart) and text (null: empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text")
    )


@dataclass
class Scan:
    """Windows of some texts. ``inside``: starts of windows that lie in one text, in units of the joined buffer."""

    grams: np.ndarray  # hashes of possible anchors, by start
    windows: np.ndarray  # hashes of windows, by start
    inside: np.ndarray
    owner: np.ndarray  # text of each of ``inside``
    origin: np.ndarray  # first unit of each text
    data: np.ndarray  # what payloads are cut from

    def runs(self, window: int, anchor: int):
        """Per run of windows with one anchor in one text: first start, number of windows, anchor's hash, text."""
        if not len(self.inside):
            return self.inside, self.inside, self.grams[:0], self.inside
        at = window_argmin(self.grams, window - anchor + 1)[self.inside]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (self.owner[1:] != self.owner[:-1])
        first = np.flatnonzero(new)
        return self.inside[first], np.diff(np.append(first, len(at))), self.grams[at[first]], self.owner[first]


@dataclass(frozen=True)
class Shape:
    """How to cut texts into windows. ``scan`` makes a :class:`Scan`; ``extra`` units follow a run's window starts in
    its payload; windows are never longer than twice the run, so first and last window determine a run."""

    scan: Callable[[list[bytes]], Scan]
    window: int
    anchor: int
    extra: int


def keys_of(shape: Shape, text_column: int):
    """For :func:`sketch.build`: the anchor of each run, once."""

    def keys(b: pa.RecordBatch):
        texts = encoded(b.column(text_column).to_pylist())
        for i, j in chunks(texts):
            yield shape.scan(texts[i:j]).runs(shape.window, shape.anchor)[2]

    return keys


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (size[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def candidates(rows: DataFrame, shape: Shape, shared) -> DataFrame:
    """Runs whose anchor is estimated repeated, keyed by it. ``shared``: broadcast of the sketch.

    Anchors estimated very frequent give a row per window, keyed by the window's own hash. Of equal runs in one
    flush of a task only the earliest keeps its payload; the others are known to go and have a null payload.
    """

    def found(b: pa.RecordBatch):
        sketch: Sketch = shared.value
        did, th = (np.asarray(b.column(i), np.int64) for i in (0, 1))
        texts = encoded(b.column(2).to_pylist())
        for i, j in chunks(texts):
            s = shape.scan(texts[i:j])
            first, size, key, doc = s.runs(shape.window, shape.anchor)
            keep = sketch.is_repeated(key)
            first, size, key, doc = first[keep], size[keep], key[keep], doc[keep]
            if not len(first):
                continue
            hot = sketch.is_hot(key)
            split = np.where(hot, size, 1)
            run = np.repeat(np.arange(len(first)), split)
            first, size, doc = spread(first, split), np.where(hot[run], 1, size[run]), doc[run]
            head, tail = s.windows[first], s.windows[first + size - 1]
            key = np.where(hot[run], mix(head), key[run])
            length = size + shape.extra
            # Few at a time: in a repetitive text every window is a run, with a payload of its own.
            part = np.cumsum(length) // PAYLOAD_SLICE
            for a, z in pairwise([0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(first)]):
                payload = s.data[spread(first[a:z], length[a:z])]
                of = doc[a:z]
                yield key[a:z], head[a:z], tail[a:z], did[i + of], th[i + of], first[a:z] - s.origin[of], size[a:z], length[a:z], payload

    def out(key, did, th, start, size, payload):
        return batch(key=signed(key), did=did, th=th, start=start.astype(np.int32), n=size.astype(np.int32), payload=payload)

    def reduced(held):
        key, head, tail, did, th, start, size, length, payload = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((start, did, size, tail, head, key))
        a, b = order[1:], order[:-1]
        same = np.zeros(len(key), bool)
        same[1:] = (key[a] == key[b]) & (head[a] == head[b]) & (tail[a] == tail[b]) & (size[a] == size[b])
        e = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))]
        later = same & ((did[order] != did[e]) | (start[order] != start[e]))
        gone, kept = order[later], np.sort(order[~same])
        if len(gone):
            # Neighbouring runs of a document become one row, dealt by document.
            gone = gone[np.lexsort((start[gone], th[gone], did[gone]))]
            d, h, s, n = did[gone], th[gone], start[gone], size[gone]
            new = np.ones(len(gone), bool)
            new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1] + n[:-1])
            first = np.flatnonzero(new)
            n = np.add.reduceat(n, first)
            yield out(mix(d[first].view(np.uint64)), d[first], h[first], s[first], n, pa.nulls(len(first), pa.binary()))
        at = np.cumsum(length) - length
        cut = blobs(payload[spread(at[kept], length[kept])], length[kept])
        yield out(key[kept], did[kept], th[kept], start[kept], size[kept], cut)

    def run(batches):
        held, n, size = [], 0, 0
        for b in batches:
            for x in found(b):
                held.append(x)
                n += len(x[0])
                size += x[-1].nbytes
                if n >= RUNS_PER_FLUSH or size >= PAYLOAD_PER_FLUSH:
                    yield from reduced(held)
                    held, n, size = [], 0, 0
        if n:
            yield from reduced(held)

    return rows.mapInArrow(run, SENT)


def spans_by_document(spans: DataFrame) -> DataFrame:
    """(did, th, start, stop) to one row per document; a document's spans are bounded by its own length."""
    return spans.groupBy("did", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """did, text, start[], stop[] of every row; null lists where nothing goes."""
    return rows.join(spans_by_document(spans), ["did", "th"], "left").select(
        "did", "text", F.col("spans.start").alias("start"), F.col("spans.stop").alias("stop")
    )


def covered(n: int, start: pa.Scalar, stop: pa.Scalar) -> np.ndarray | None:
    """Which of ``n`` units lie in a span; None if there are no spans."""
    if not start.is_valid:
        return None
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.asarray(start.values), 1)
    np.add.at(edge, np.asarray(stop.values), -1)
    return np.cumsum(edge[:-1]) > 0
