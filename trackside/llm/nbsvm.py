"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model.

Features are indicators ("does the n-gram occur?") of byte n-grams (1 to 3), words, and n-grams (1 to 3) of word
shapes: same word as before, letter case, last byte a letter or digit. They are hashed to ``FEATURES`` columns.

* Log-count ratios r come from *all* labelled training rows: per column the number of documents of each class that
  have it, smoothed by ``ALPHA``. A document is r at its indicators, scaled to length 1.
* The hinge loss is minimised by dual coordinate descent on at most ``SAMPLE_PER_CLASS`` training rows of each
  class, those with the smallest hashes of their ids (a fixed sample, which bounds the fit).
  A quarter of them is left out of the fit and turns margins into probabilities, weighted back to the classes' shares.

Null text counts as empty; an empty text has no feature and gets the score of margin ``bias``. Rows are scored one by
one, repeats alike. If one class has no training row, the score is the share of the other class. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import batch, in_arrow, prepare, slim
from trackside.llm.textscan import byte_weights, chunks, encoded, gram_hashes, scan_words

BITS = 18
FEATURES = 1 << BITS
BLOCK = 1 << 12
ALPHA = 1.0
SAMPLE_PER_CLASS = 6000
COST = 1.0
EPOCHS = 20
SEED = 7
FOLDS = 5
CUT = 0.3

_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[ord("A") : ord("Z") + 1] = 1
_LOWER = np.zeros(256, np.int32)
_LOWER[ord("a") : ord("z") + 1] = 1


def _columns(hashes: np.ndarray, kind: int) -> np.ndarray:
    return ((hashes + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct columns of each text."""
    out: list[np.ndarray] = []
    seen = np.zeros(FEATURES, np.int32)
    for i, j in chunks(texts):
        w = scan_words(texts[i:j])
        weights = byte_weights(w.data)
        grams = [_columns(weights if n == 1 else gram_hashes(weights, n), n) for n in (1, 2, 3)]
        words = _columns(w.hashes, 4)
        same = np.zeros(len(w.hashes), np.uint64)
        same[1:] = w.hashes[1:] == w.hashes[:-1]
        if len(w.begin):
            upper = np.add.reduceat(_UPPER[w.data], w.begin) > 0  # up to the next word: only white space is added
            lower = np.add.reduceat(_LOWER[w.data], w.begin) > 0
            shape = same + 2 * upper.astype(np.uint64) + 4 * lower.astype(np.uint64)
            shape += 8 * _LETTER[w.data[w.end - 1]].astype(np.uint64)
        else:
            shape = same
        shape = (shape + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        shapes = [_columns(shape if n == 1 else gram_hashes(shape, n), 4 + n) for n in (1, 2, 3)]
        at = 0
        for k, text in enumerate(texts[i:j]):
            a, b = w.first[k], w.first[k + 1]
            parts = [g[at : max(at, at + len(text) - n)] for n, g in enumerate(grams)]
            parts += [words[a:b], *(s[a : max(a, b - n)] for n, s in enumerate(shapes))]
            column = np.concatenate(parts)
            place = np.arange(len(column), dtype=np.int32)
            seen[column] = place
            out.append(column[seen[column] == place])
            at += len(text) + 1
    return out


@dataclass
class Model:
    """``weight``: per column the ratio times the fitted weight; ``square``: the ratio squared."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        margin = np.array([self.margin(c) for c in features(texts)])
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))

    def margin(self, columns: np.ndarray) -> float:
        length = float(np.sqrt(self.square[columns].sum(dtype=np.float64))) or 1.0
        return float(self.weight[columns].sum(dtype=np.float64)) / length + self.bias


def descend(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: float, epochs: int) -> np.ndarray:
    """Dual coordinate descent for the L1 hinge loss; the last weight is the bias."""
    w = np.zeros(FEATURES + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    random = np.random.default_rng(SEED)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(rows)):
            columns, values = rows[i]
            y = labels[i]
            gradient = y * (w[columns] @ values + w[-1]) - 1
            moved = min(max(alpha[i] - gradient / norm[i], 0.0), cost) - alpha[i]
            if moved:
                alpha[i] += moved
                w[columns] += moved * y * values
                w[-1] += moved * y
                worst = max(worst, abs(moved))
        if worst < 1e-3:
            break
    return w


def calibrate(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins (Newton steps, slightly regularised)."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - good)) + 1e-3 * theta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def in_training(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS != 0, F.lit(False))


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class by column (2 x FEATURES) and in all, over every row of (text, label)."""

    def count(batches):
        total, rows = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for c, label in zip(features(encoded(b.column(0).to_pylist())), b.column(1).to_pylist()):
                total[label, c] += 1
                rows[label] += 1
        if rows.sum():
            for k in range(0, FEATURES, BLOCK):
                yield batch(block=pa.array([k // BLOCK], pa.int32()), counts=[np.ascontiguousarray(total[:, k : k + BLOCK]).tobytes()])
            yield batch(block=pa.array([-1], pa.int32()), counts=[rows.tobytes()])

    def add(batches):
        now, total = None, None
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(counts, np.int64)
                if block != now:
                    if now is not None:
                        yield batch(block=pa.array([now], pa.int32()), counts=[total.tobytes()])
                    now, total = block, part.copy()
                else:
                    total += part
        if now is not None:
            yield batch(block=pa.array([now], pa.int32()), counts=[total.tobytes()])

    parts = in_arrow(labelled, count, "block int, counts binary").repartition("block").sortWithinPartitions("block")
    counts, rows = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for r in in_arrow(parts, add, "block int, counts binary").collect():  # FEATURES / BLOCK + 1 rows at most
        got = np.frombuffer(r.counts, np.int64)
        if r.block < 0:
            rows = got
        else:
            counts[:, r.block * BLOCK : (r.block + 1) * BLOCK] = got.reshape(2, BLOCK)
    return counts, rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    known = labels.where(F.col(label_col).isin(0, 1) & in_training(id_col)).select(
        F.col(id_col).alias("did"), F.col(label_col).cast("int").alias("label")
    )
    texts = docs.where(in_training(id_col)).select(
        F.col(id_col).alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    # Texts are shuffled, labels hashed: the same way for any number of labels.
    counts, rows = class_counts(texts.join(known.hint("shuffle_hash"), "did").select("text", "label"))
    share = rows / max(rows.sum(), 1)
    if not rows.all():
        odds = float(np.log((share[1] + 1e-6) / (share[0] + 1e-6)))
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, 0.0, odds if rows.sum() else 0.0)
    p, q = counts[1] + ALPHA, counts[0] + ALPHA
    ratio = np.log((p / p.sum()) / (q / q.sum()))

    order = [F.xxhash64("did"), F.col("did")]
    sample = known.where("label = 0").orderBy(*order).limit(SAMPLE_PER_CLASS)
    sample = sample.unionByName(known.where("label = 1").orderBy(*order).limit(SAMPLE_PER_CLASS))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def represent(batches):
        for b in batches:
            found = features(encoded(b.column(1).to_pylist()))
            yield batch(did=b.column(0), label=b.column(2), columns=pa.array([c.tobytes() for c in found], pa.binary()))

    def learn(batches):
        ids, labels, columns = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
            columns += [np.frombuffer(c, np.int32) for c in b.column(2).to_pylist()]
        if not ids:
            return
        order = np.argsort(np.array(ids), kind="stable")
        good = np.array(labels)[order]
        rows = []
        for i in order:
            values = shared.value[columns[i]]
            rows.append((columns[i], values / (np.sqrt(values @ values) or 1.0)))
        aside = np.arange(len(rows)) % 4 == 3
        train = np.flatnonzero(~aside)
        w = descend([rows[i] for i in train], 2.0 * good[train] - 1, COST, EPOCHS)
        margins = np.array([w[c] @ v + w[-1] for c, v in rows])
        aside = aside if len(set(good[aside])) == 2 else ~aside
        seen = np.bincount(good[aside], minlength=2)
        slope, shift = calibrate(margins[aside], good[aside], (share / np.maximum(seen, 1))[good[aside]] * aside.sum())
        yield batch(weights=[w.tobytes()], slope=[slope], shift=[shift])

    # Of bounded size: at most 2 * SAMPLE_PER_CLASS ids are broadcast, and their rows meet in one task.
    picked = texts.join(F.broadcast(sample), "did").select("did", "text", "label")
    picked = in_arrow(picked, represent, "did long, label int, columns binary").repartition(1)
    made = in_arrow(picked, learn, "weights binary, slope double, shift double").first()
    if made is None:
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, 0.0, 0.0)
    w = np.frombuffer(made.weights)
    return Model((w[:-1] * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(w[-1]), made.slope, made.shift)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score_col``, which must not be among them; no shuffle."""
    if score_col.lower() in [c.lower() for c in docs.columns]:
        raise ValueError(f"{score_col} is a column of the table; name another one")
    # Text alone goes to Python and back with the row, so that other columns of any type stay as they are.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in parts:
                yield pd.Series(shared.value.scores(encoded(texts)))
        finally:
            slim()

    return docs.withColumn(score_col, scored(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    prepare(docs.sparkSession)
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def kept_by_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that reach ``cut``, with their columns as they are."""
    prepare(docs.sparkSession)
    name = "_score"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    return score(docs, fit(docs, labels), score_col=name).where(F.col(name) >= cut).drop(name)
