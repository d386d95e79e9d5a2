"""What the operators share on the Spark side: settings, batches, components, running sums."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside.llm.textscan import forget

# Texts can be long: few rows a batch keep a Python worker's memory small.
ARROW_ROWS = "512"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings. A cluster gets the package by --py-files or installed; local workers find it by path."""
    if spark.sparkContext.master.startswith("local["):
        root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH"), os.environ.get("PYTHONPATH")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: the setting ``spark.checkpoint.dir``, or the context's own.

    Where neither is set, as in tests, a local session gets a folder of its machine; a cluster is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


NARROW = 8


def few(df: DataFrame) -> DataFrame:
    """For rows that hold ids only, an eighth of the partitions that rows with texts need; no shuffle."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // NARROW))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: later stages survive lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slim() -> None:
    """Give memory back to the system: idle workers stay beside their executor for a while."""
    forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose worker is slim again when a partition ends."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            slim()

    return df.mapInArrow(run, schema)


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` for each Arrow batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return in_arrow(df, run, schema)


def batch(**columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


FILTER_BITS = 24


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def may_contain(ids: DataFrame, bits: int = FILTER_BITS):
    """A column function that is true for every value of the one long column ``ids``, and rarely for others.

    A bitmap of 2**bits cells, whatever the number of ids: it thins out a table before a join, which decides.
    """
    (name,) = ids.columns
    cell = F.shiftrightunsigned(F.xxhash64(F.col(name)), 64 - bits)
    words = ids.select(F.shiftright(cell, 6).cast("int").alias("at"), cell.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = words.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    for r in words.toLocalIterator():  # 2**(bits - 6) rows at most
        bitmap[r["at"]] = r["bits"]
    shared = ids.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.pandas_udf("boolean")
    def hit(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)
        return pd.Series((shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0)

    return lambda column: hit(F.xxhash64(F.col(column)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)


def blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Cut an array into binary values of the given numbers of elements."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes * values.itemsize, out=offsets[1:])
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def joined(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a binary column, one after the other, and the number in each row."""
    values = column.to_pylist()
    sizes = np.array([len(v) for v in values], np.int64) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(values), dtype), sizes


EDGES_AT_ONCE = 1 << 20
FEWER = 0.75


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes as (a, b): one for each node but its component's smallest, from that to the node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        one, two = root[x], root[y]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def contract(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the same components, ``EDGES_AT_ONCE`` of a task contracted at a time."""

    def run(batches):
        held, n = [], 0
        for rows in batches:
            held.append((np.asarray(rows.column(0)), np.asarray(rows.column(1))))
            n += rows.num_rows
            if n >= EDGES_AT_ONCE:
                yield from flushed(held)
                held, n = [], 0
        if n:
            yield from flushed(held)

    def flushed(held):
        low, high = contracted(*(np.concatenate(x) for x in zip(*held)))
        yield batch(a=low, b=high)

    return in_arrow(edges, run, "a long, b long")


def components(edges: DataFrame, label: str, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component) for every node on an edge; the component is its smallest node.

    Each task first contracts the edges it has, before and after they are dealt by their larger node. A node of a large component still has
    an edge from each task that met it, so this is repeated until few edges go: about one is left for each node, whatever the
    number of tasks. Then, in each round, every node takes
    the smallest label among itself and its neighbours, and then the label of its label (pointer jumping), so long chains shorten by half:
    few rounds are left, each of which is several jobs that the driver plans. Nodes and edges stay distributed; a
    hub with many edges is pre-aggregated by min() before its shuffle. Each round is written to the shared folder.
    """

    def dealt(now: DataFrame) -> tuple[DataFrame, int]:
        out = stored(contract(few(now.repartition("b"))), f"{label}-edges")
        return out, out.count()

    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    pairs, left = dealt(contract(pairs))
    fewer = True
    while fewer:
        before, had = pairs, left
        pairs, left = dealt(before)
        discard(before)
        fewer = left < FEWER * had
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    first = both.groupBy("node").agg(F.least("node", F.min("other")).alias("component"))
    now = stored(few(first), f"{label}-round")
    while True:
        seen = few(both.join(now.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other"))
        best = few(seen.groupBy("node").agg(F.min("theirs").alias("theirs")))
        hooked = few(now.join(best, "node")).select(
            "node", F.least("component", "theirs").alias("component"), F.col("component").alias("before")
        )
        # The smallest label anybody with my old label has found: whole components move together.
        roots = few(hooked.groupBy("before").agg(F.min("component").alias("root")))
        after = stored(
            few(hooked.join(roots, "before")).select(
                "node", F.least("component", "root").alias("component"), (F.col("root") < F.col("before")).alias("moved")
            ),
            f"{label}-round",
        )
        done = after.where("moved").limit(1).count() == 0
        discard(now)
        now = after.drop("moved")
        if done:
            discard(pairs)
            return now
