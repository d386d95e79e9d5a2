"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are taken relative to their mean, scaled to length 1 and rotated at random; a code is the sign of each coordinate,
packed to bits. With o the unit vector, x its code as a unit vector and q a rotated query, <x, q> / <x, o> estimates <o, q>
without bias, with an error of about |q| sqrt((1 - <x, o>^2) / <x, o>^2 / (D - 1)). Inner products of the original
vectors follow from the stored scalars (distance to the mean, <x, o>, inner product with the mean).

Rows are dealt to blocks of candidates by hash, queries to blocks of queries; a task has one block of each. It estimates all
inner products from the codes, computes the most promising ones exactly, and then every vector whose
estimate plus ``BOUND`` times its error reaches the k-th best exact score so far. Nothing else limits the candidates. The
best k of each block are merged. So work grows with queries times rows, as the fixed query set asks, in
blocks of bounded size.

Scores are inner products of the original vectors in double precision, added up in order of dimension. Vectors that
are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths are never compared. Rows
with equal ids count once per id, with the smallest vector. Ties go to the smaller id. Fewer candidates: all of them.
Null ids take no part. Extra columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackside.llm.common import batch, prepare, stored

TOP = 20
EVERY = 20
BOUND = 3.5
SEED = 3
CANDIDATES = 16_384  # vectors in a block, on average
QUERIES = 4_096
QUERY_STEP = 64


def rotation(dimension: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    matrix = np.random.default_rng(SEED + dimension).standard_normal((dimension, dimension))
    q, r = np.linalg.qr(matrix)
    return q * np.sign(np.diag(r))


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added up in order of dimension: equal vectors get equal scores."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += rows[:, d] * query[d]
    return total


class Codes:
    """The index of a block of vectors: packed signs and, per vector, its correction scalars."""

    def __init__(self, rows: np.ndarray, mean: np.ndarray):
        d = rows.shape[1]
        apart = rows - mean
        self.length = np.sqrt((apart**2).sum(1))
        unit = (apart / np.maximum(self.length, 1e-300)[:, None]) @ rotation(d)
        self.bits = np.packbits(unit >= 0, axis=1)
        self.aligned = np.maximum(np.abs(unit).sum(1) / math.sqrt(d), 1e-12)  # <x, o>
        self.spread = np.sqrt(np.maximum(1 - self.aligned**2, 0)) / self.aligned / math.sqrt(max(d - 1, 1))
        self.dimension = d

    def estimates(self, queries: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rotated queries: inner products with all vectors, and the size of their errors."""
        signs = np.unpackbits(self.bits, axis=1, count=self.dimension).astype(np.float32) * 2 - 1
        code = (queries @ rotation(self.dimension)).astype(np.float32) @ signs.T / math.sqrt(self.dimension)
        scale = (self.length / self.aligned)[None, :]
        size = np.sqrt((queries**2).sum(1))[:, None]
        return code * scale + (queries @ mean)[:, None], size * (self.length * self.spread)[None, :] + 1e-6 * size * scale


def nearest(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, mean: np.ndarray, top: int, bound: float):
    """(query, id, score): the best ``top`` of the block for each query; ``ids`` ascending and distinct."""
    codes = Codes(rows, mean)
    for at in range(0, len(queries), QUERY_STEP):
        part = queries[at : at + QUERY_STEP]
        estimate, error = codes.estimates(part, mean)
        for k, query in enumerate(part):
            own = np.searchsorted(ids, query_ids[at + k])
            other = np.ones(len(ids), bool)
            if own < len(ids) and ids[own] == query_ids[at + k]:
                other[own] = False
            reach = np.where(other, estimate[k] + bound * error[k], -np.inf)
            n = int(other.sum())
            if n == 0:
                continue
            least = -np.inf
            if n > 2 * top:
                guess = np.argpartition(-np.where(other, estimate[k], -np.inf), 2 * top)[: 2 * top]
                least = np.partition(exact(rows[guess], query), -top)[-top]
            chosen = np.flatnonzero(other & (reach >= least))
            if len(chosen) < min(top, n):
                chosen = np.flatnonzero(other)
            score = exact(rows[chosen], query)
            best = np.lexsort((ids[chosen], -score))[:top]
            yield query_ids[at + k], ids[chosen[best]], score[best]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dimension and vector (double) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    # Not finite: the difference to itself is not zero.
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x - x))
    return (
        df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
        .where(~bad & F.exists("vector", lambda x: x != 0))
        .select("id", F.size("vector").alias("dimension"), "vector")
    )


def search(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    top: int = TOP,
    bound: float = BOUND,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: a condition on the column ``id``."""
    spark = prepare(df.sparkSession)
    rows = stored(usable(df, id_col, vector_col), "vectors")
    # Means and counts: one number per dimension, from all rows.
    sizes = {r.dimension: (r.n, r.q) for r in rows.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("long")).alias("q")).collect()}
    sums: dict[int, np.ndarray] = {d: np.zeros(d) for d in sizes}
    each = rows.select("dimension", F.posexplode("vector")).groupBy("dimension", "pos").agg(F.avg("col").alias("mean"))
    for r in each.toLocalIterator():
        sums[r.dimension][r.pos] = r["mean"]
    shared = spark.sparkContext.broadcast(sums)
    blocks = F.create_map(*[F.lit(x) for d, (n, _) in sizes.items() for x in (d, math.ceil(n / candidates))]) if sizes else None
    query_blocks = F.create_map(*[F.lit(x) for d, (_, q) in sizes.items() for x in (d, math.ceil(max(q or 0, 1) / queries))]) if sizes else None
    schema = f"query_id long, rank int, {id_col} long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    c, q = F.element_at(blocks, F.col("dimension")), F.element_at(query_blocks, F.col("dimension"))
    hashed = F.xxhash64("id")
    as_candidate = rows.withColumn("block", F.pmod(hashed, c).cast("int")).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), q - 1))
    ).withColumn("is_query", F.lit(False))
    as_query = rows.where(is_query).withColumn("query_block", F.pmod(hashed, q).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), c - 1))
    ).withColumn("is_query", F.lit(True))
    keys = ["dimension", "block", "query_block"]
    both = as_candidate.select(*keys, "is_query", "id", "vector").unionByName(as_query.select(*keys, "is_query", "id", "vector"))

    def solve(dimension, ids, vectors, flags):
        ids, flags = np.array(ids, np.int64), np.array(flags, bool)
        rows = np.frombuffer(b"".join(vectors)).reshape(-1, dimension)
        mean = shared.value[dimension]

        def side(mask):
            i, v = ids[mask], rows[mask]
            order = np.lexsort((*v.T[::-1], i))  # by id, then by vector
            i, v = i[order], v[order]
            one = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
            return i[one], v[one]

        (ci, cv), (qi, qv) = side(~flags), side(flags)
        if not len(ci) or not len(qi):
            return
        found = list(nearest(ci, cv, qi, qv, mean, top, bound))
        if found:
            yield batch(
                query_id=np.concatenate([np.full(len(i), x, np.int64) for x, i, _ in found]),
                id=np.concatenate([i for _, i, _ in found]), score=np.concatenate([s for _, _, s in found]),
            )

    def run(batches):
        now, ids, vectors, flags = None, [], [], []
        for b in batches:
            lists = b.column(5)
            values, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            for k, key in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
                if key != now:
                    if now is not None:
                        yield from solve(now[0], ids, vectors, flags)
                    now, ids, vectors, flags = key, [], [], []
                ids.append(b.column(4)[k].as_py())
                flags.append(b.column(3)[k].as_py())
                vectors.append(values[ends[k] : ends[k + 1]].tobytes())
        if now is not None:
            yield from solve(now[0], ids, vectors, flags)

    found = both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias(id_col), "score")
