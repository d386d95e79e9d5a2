"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

A row's score for an anchor is the inner product of their integer vectors. Rows are dealt to blocks by a hash of their id; a
block keeps, for every dimension, the list of its rows in order of that component. For an anchor each list is read
from the end that its component's sign prefers; rows met in any list get their whole integer score by random access. The sum of
anchor component times last value read, the threshold, bounds the score of every row not met yet. Reading stops once
the threshold is strictly below the k-th score of each window (for positives: the best of the anchor's own label; for
negatives: the range of scores that a positive allows), or below all a window takes: ties stay in. Depths double.

Two rounds over (block of rows, block of anchors): positives of each anchor, merged over the blocks, then their windows'
negatives. A task holds one block of rows and streams the anchors' blocks past it. Work grows with anchors times
rows, as the stated anchors ask; nothing is capped.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part.
Vectors of different lengths are never compared. Rows that share an id count once, the one with the shortest vector,
then smallest label, then smallest vector. Scaled components and scores saturate at the range of a long. Higher scores come
first, ties by smaller id. Anchors without positives, and positives without negatives, have no rows. Extra columns do
not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackside.llm.common import prepare, stored

POSITIVES = 5
NEGATIVES = 3
SCALE = 256
EVERY = 50
BLOCK = 4_096  # rows in a block, on average
ANCHORS = 64
FIRST_DEPTH = 16
LONG = (1 << 63) - 1


class Lists:
    """Sorted lists of a block, one for every dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.most = max(int(rows.max()), -int(rows.min()), 1)

    @cached_property
    def exact(self) -> np.ndarray:
        """Integers as doubles, for sums below 2**53."""
        return self.rows.astype(np.float64)

    @cached_property
    def unbounded(self) -> np.ndarray:
        return self.rows.astype(object)

    def scored(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows met by and by, with their scores and the threshold for the rest; None: there is no rest."""
        n, d = self.rows.shape
        large = max(int(anchor.max()), -int(anchor.min())) * self.most * d >= 1 << 53
        rows, weights = (self.unbounded, anchor.astype(object)) if large else (self.exact, anchor.astype(np.float64))
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):
            yield np.arange(n), np.zeros(n, np.int64), None
            return
        met, done, depth = np.zeros(n, bool), 0, FIRST_DEPTH
        while done < n:
            depth = min(depth, n)
            here = np.zeros(n, bool)
            here[self.order[up, n - depth : n - done].ravel()] = True
            here[self.order[down, done:depth].ravel()] = True
            new = np.flatnonzero(here & ~met)
            met |= here
            score = rows[new] @ weights
            bound = weights[up] @ rows[self.order[up, n - depth], up] + weights[down] @ rows[self.order[down, depth - 1], down]
            score = np.array([max(-LONG, min(LONG, s)) for s in score], np.int64) if large else score.astype(np.int64)
            if met.all():
                yield new, score, None
                return
            yield new, score, int(bound)
            done, depth = depth, 2 * depth


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:
        least = np.partition(scores, -k)[-k]
        keep = np.flatnonzero(scores >= least)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def settled(scores: np.ndarray, bound: int | None, k: int, low: int = -LONG) -> bool:
    """Can no row with a score up to ``bound`` come in among the first ``k`` of this window?"""
    if bound is None or bound < low:
        return True
    return len(scores) >= k and bound < np.partition(scores, -k)[-k]


def positives(lists: Lists, anchor_id: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for new, score, bound in lists.scored(anchor):
        other = lists.ids[new] != anchor_id
        at, scores = np.concatenate([at, new[other]]), np.concatenate([scores, score[other]])
        if settled(scores, bound, k):
            break
    keep = best(lists.ids[at], scores, k)
    return lists.ids[at[keep]], scores[keep]


def window(positive_score: int) -> tuple[int, int]:
    """Negatives' scores run from half to 95 hundredths of the positive's."""
    return -(-positive_score // 2), 19 * positive_score // 20


def negatives(lists: Lists, other: np.ndarray, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window ids and scores; ``other`` marks the rows of other labels."""
    at, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for new, score, bound in lists.scored(anchor):
        mine = other[new]
        at, scores = np.concatenate([at, new[mine]]), np.concatenate([scores, score[mine]])
        if all(settled(scores[(scores >= low) & (scores <= high)], bound, k, low) for low, high in windows):
            break
    out = []
    for low, high in windows:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        keep = inside[best(lists.ids[at[inside]], scores[inside], k)]
        out.append((lists.ids[at[keep]], scores[keep]))
    return out


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, dimension, label and integer vector of the rows that take part, one per id."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector")).where(
        "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0"
    )
    # Not finite: the difference to itself is not zero.
    rows = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x - x)))
    scaled = F.transform("vector", lambda x: F.floor(x * scale))
    one = F.min(F.struct(F.size("vector").alias("dimension"), "label", scaled.alias("vector")))
    return rows.groupBy("id").agg(one.alias("one")).select("id", "one.*")


PACKED = "dimension int, block int, n int, ids binary, labels binary, vectors binary, given binary, known binary"


def pack(key, group):
    """A block as one row: ids ascending; positives' numbers and, one anchor after the other, their ids and scores."""
    group = group.sort_by("id")
    flat = lambda name: group.column(name).combine_chunks().values.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    rows = {
        "dimension": key[0].as_py(), "block": key[1].as_py(), "n": len(group), "ids": group.column("id").to_numpy().astype("<i8").tobytes(),
        "labels": group.column("label").to_numpy().astype("<i8").tobytes(), "vectors": flat("vector"), "given": None, "known": None,
    }
    if "positives" in group.column_names:
        lists = group.column("positives").to_pylist()
        rows["given"] = np.array([len(p) for p in lists], "<i8").tobytes()
        rows["known"] = np.array([(x["id"], x["score"]) for p in lists for x in p], "<i8").tobytes()
    return pa.table({k: pa.array([v], t) for (k, v), t in zip(rows.items(), [pa.int32()] * 3 + [pa.binary()] * 5)})


def blocked(rows: DataFrame, sizes: dict[int, int], each: int) -> tuple[DataFrame, Column]:
    """Rows in packed blocks of about ``each``, and the number of blocks by dimension."""
    pairs = [F.lit(x) for d, n in sizes.items() for x in (d, max(1, math.ceil(n / each)))]
    count = F.element_at(F.create_map(*pairs), F.col("dimension"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), count).cast("int"))
    return dealt.groupBy("dimension", "block").applyInArrow(pack, PACKED), count


def met(blocks: DataFrame, count: Column, anchors: DataFrame, solve, schema: str) -> DataFrame:
    """Every block of anchors passes every block of rows of its dimension."""
    every = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    both = blocks.withColumn("side", F.lit(0)).unionByName(every.withColumn("side", F.lit(1)))
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        lists = labels = None
        for b in batches:
            for r in b.to_pylist():
                ids, of = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
                rows = np.frombuffer(r["vectors"], "<i8").reshape(r["n"], r["dimension"])
                if r["side"] == 0:
                    lists, labels = Lists(ids, rows), of
                    own: dict[int, Lists] = {}
                    continue
                given = np.frombuffer(r["given"] or b"", "<i8")
                known = np.split(np.frombuffer(r["known"] or b"", "<i8").reshape(-1, 2), np.cumsum(given)[:-1])
                found = [x for k in range(r["n"]) for x in solve(lists, labels, own, ids[k], of[k], rows[k], known[k] if len(given) else None)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)

    # A fixed number: what a block costs is not its size, so partitions must not be merged by that.
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "dimension", "block").sortWithinPartitions("dimension", "block", "side")
    return dealt.mapInArrow(run, schema)


def mined(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    block: int = BLOCK,
    anchors_in_block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``is_anchor``: a condition on ``id``."""
    spark = prepare(df.sparkSession)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = stored(usable(df, id_col, vector_col, label_col, scale), "vectors")
    # One number per length of vectors.
    counted = rows.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("a")).collect()
    sizes, anchor_sizes = {r.dimension: r.n for r in counted}, {r.dimension: r.a for r in counted}
    if not sizes:
        return spark.createDataFrame([], schema)
    blocks, count = blocked(rows, sizes, block)
    blocks = stored(blocks, "blocks")
    anchors = rows.where(is_anchor)

    def of_own_label(lists, labels, own, anchor_id, label, anchor, _):
        if label not in own:
            at = np.flatnonzero(labels == label)
            own[label] = Lists(lists.ids[at], lists.rows[at]) if len(at) else None
        if own[label] is not None:
            for i, s in zip(*positives(own[label], anchor_id, anchor, n_positives)):
                yield anchor_id, i, s

    def of_other_labels(lists, labels, own, anchor_id, label, anchor, known):
        known = [(int(i), int(s)) for i, s in known if s >= 0]  # below zero a window is empty
        if known:
            found = negatives(lists, labels != label, anchor, [window(s) for _, s in known], n_negatives)
            for (i, s), (ids, scores) in zip(known, found):
                for j, t in zip(ids, scores):
                    yield anchor_id, i, j, s, t

    first = met(blocks, count, blocked(anchors, anchor_sizes, anchors_in_block)[0], of_own_label, "anchor_id long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    kept = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n_positives)
    chosen = kept.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("positives"))  # n_positives at most
    asked = stored(anchors.join(chosen.withColumnRenamed("anchor_id", "id"), "id"), "anchors")
    found = met(
        blocks, count, blocked(asked, anchor_sizes, anchors_in_block)[0], of_other_labels,
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
