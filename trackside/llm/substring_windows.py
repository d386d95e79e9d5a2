"""Substring de-duplication with a count-min prefilter.

A window is ``window`` consecutive words. Each word covered by a window whose word sequence also starts earlier
(in a document of smaller id, or earlier in the same document) is removed.

1. Partition sketches are merged into a count-min sketch (:mod:`sketch`). A window is counted under its *anchor*,
   the run of ``anchor`` words in it with the smallest hash (the leftmost of equals): equal windows have equal
   anchors at equal distances, so an anchor's count is never below the count of a window that has it, and
   consecutive windows share anchors, which makes the sketch several times smaller.
2. A second pass sends only the windows whose anchor is estimated repeated, keyed by anchor, consecutive ones in one
   row. Equal rows of a task are reduced to the earliest before the shuffle. Windows of an anchor that is
   estimated very frequent are keyed one by one by their own hash, so that no anchor fills one task.
3. Windows are grouped exactly by (anchor, window) hashes, 128 bits together; all but the earliest go.

Rows: null text counts as empty, null id as the largest. Rows with equal ids and texts get equal results and
are not earlier than one another. Other columns are ignored by the search and kept in the output.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.llm import sketch as cms
from trackside.llm.anchors import LAST_ID, Scan, Shape, candidates, covered, keyed, keys_of, spread, with_spans
from trackside.llm.common import batch, joined, prepare, unsigned
from trackside.llm.textscan import encoded, gram_hashes, scan_words

WINDOW = 20
ANCHOR = 8
WIDTH_BITS = 27  # cells per row of the sketch: 2 rows + 1, 48 MB in all
HOT = 2000


def scan_windows(window: int, anchor: int, texts: list[bytes]) -> Scan:
    """In units of words; the payload of a run are its windows' hashes."""
    words = scan_words(texts)
    inside = np.flatnonzero(words.whole_runs(window))
    hashes = gram_hashes(words.hashes, window)
    return Scan(gram_hashes(words.hashes, anchor), hashes, inside, words.owner[inside], words.first[:-1], hashes)


def repeated_spans(rows: DataFrame, window: int, anchor: int, width_bits: int, hot: int) -> DataFrame:
    """(did, th, start, stop): word ranges to remove; those of one document may overlap."""
    shape = Shape(partial(scan_windows, window, anchor), window, anchor, 0)
    sketch = cms.build(rows.select("text"), keys_of(shape, 0), width_bits, hot)
    sent = candidates(rows, shape, rows.sparkSession.sparkContext.broadcast(sketch))

    def ranges(did, th, start, n):
        return batch(did=did, th=th, start=start.astype(np.int32), stop=(start + n + window - 1).astype(np.int32))

    def grouped(batches):
        held = []
        for b in batches:
            known = np.asarray(b.column(5).is_null())
            did, th, start, n = (np.asarray(b.column(i)).astype(np.int64) for i in (1, 2, 3, 4))
            if known.any():
                yield ranges(did[known], th[known], start[known], n[known])
            if not known.all():
                hashes, size = joined(b.column(5).filter(pa.array(~known)), np.uint64)
                held.append((unsigned(np.asarray(b.column(0)))[~known], did[~known], th[~known], start[~known], size, hashes))
        if not held:
            return
        key, did, th, start, size, hashes = (np.concatenate(x) for x in zip(*held))
        row = np.repeat(np.arange(len(key)), size)
        pos = spread(start, size)
        order = np.lexsort((pos, did[row], hashes, key[row]))
        r = row[order]
        same = np.zeros(len(order), bool)
        same[1:] = (key[r[1:]] == key[r[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
        e = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = same & ((did[r] != did[row[e]]) | (pos[order] != pos[e]))
        gone = np.sort(order[later])
        if len(gone):
            new = np.ones(len(gone), bool)
            new[1:] = (row[gone[1:]] != row[gone[:-1]]) | (gone[1:] != gone[:-1] + 1)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(gone)))
            yield ranges(did[row[gone[first]]], th[row[gone[first]]], pos[gone[first]], n)

    return sent.repartition("key").mapInArrow(grouped, "did long, th long, start int, stop int")


def remove_repeated_windows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    width_bits: int = WIDTH_BITS,
    hot: int = HOT,
) -> DataFrame:
    """Per row of ``docs``: id_col, n_words, n_removed, kept_text (kept words joined by a space), kept_sha256."""
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    marked = with_spans(rows, repeated_spans(rows, window, anchor, width_bits, hot))

    def kept(batches):
        for b in batches:
            texts = encoded(b.column(1).to_pylist())
            words_in, removed, digests, left = [], [], [], []
            for i, text in enumerate(texts):
                words = text.split()  # ASCII white space only, as bytes
                words_in.append(len(words))
                gone = covered(len(words), b.column(2)[i], b.column(3)[i])
                if gone is not None:
                    words = list(compress(words, ~gone))
                removed.append(words_in[-1] - len(words))
                text = b" ".join(words)
                digests.append(hashlib.sha256(text).hexdigest())
                left.append(text.decode("utf-8", "surrogatepass"))
            yield batch(
                did=b.column(0), n_words=pa.array(words_in, pa.int64()), n_removed=pa.array(removed, pa.int64()),
                kept_text=pa.array(left, pa.string()), kept_sha256=digests,
            )

    out = marked.mapInArrow(kept, "did long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.select(
        F.when(F.col("did") != LAST_ID, F.col("did")).alias(id_col), "n_words", "n_removed", "kept_text", "kept_sha256"
    )
