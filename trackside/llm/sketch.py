"""A count-min sketch made of partition sketches that are merged on the executors.

Every task counts its own keys in ``DEPTH`` rows of ``width`` cells and sends only the cells it has
touched; the parts are added up per block of cells, one block at a time. What reaches the driver are two
bitmaps of fixed size (``DEPTH * width`` and ``width`` bits), whatever the size of the input: cells with a
count of two or more, and cells of the first row with ``hot`` or more. A key whose cells are all in the first
bitmap is *estimated* repeated. Counts only ever add up, so no repeated key is missed; on larger inputs than the
width suits, more single keys pass as well, which costs time and not results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import batch
from trackside.llm.textscan import mix

DEPTH = 2
BLOCK_BITS = 18
KEYS_PER_PART = 1 << 21  # a task sends its sketch after so many keys


class Sketch:
    """The merged bitmaps; travels to the executors as a broadcast value."""

    def __init__(self, width_bits: int):
        self.width_bits = width_bits
        self.repeated = np.zeros((DEPTH, 1 << (width_bits - 3)), np.uint8)
        self.hot = np.zeros(1 << (width_bits - 3), np.uint8)

    @staticmethod
    def _bit(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0

    def is_repeated(self, keys: np.ndarray) -> np.ndarray:
        found = self._bit(self.repeated[0], cells(keys, 0, self.width_bits))
        some = np.flatnonzero(found)
        for row in range(1, DEPTH):
            found[some] &= self._bit(self.repeated[row], cells(keys[some], row, self.width_bits))
        return found

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        return self._bit(self.hot, cells(keys, 0, self.width_bits))


def cells(keys: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    salted = mix(keys + np.uint64(0x632BE59BD9B4E019 * (row + 1) % (1 << 64)))
    return (salted >> np.uint64(64 - width_bits)).astype(np.int64)


def build(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], width_bits: int, hot: int) -> Sketch:
    """Sketch the 64-bit keys that ``keys_of`` finds in each batch of ``df``."""
    per_row = 1 << (width_bits - BLOCK_BITS)
    inside = (1 << BLOCK_BITS) - 1

    def part(held: list[np.ndarray]):
        keys = np.concatenate(held)
        for row in range(DEPTH):
            cell, count = np.unique(cells(keys, row, width_bits), return_counts=True)
            block = cell >> BLOCK_BITS
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(cuts[1:], len(cell))
            count = np.minimum(count, 255).astype(np.uint8)
            place = (cell & inside).astype(np.uint32)
            yield batch(
                block=(block[cuts] + row * per_row).astype(np.int32),
                places=pa.array([place[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                counts=pa.array([count[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            )

    def partition_sketches(batches):
        held, size = [], 0
        for b in batches:
            for keys in keys_of(b):
                held.append(keys)
                size += len(keys)
                if size >= KEYS_PER_PART:
                    yield from part(held)
                    held, size = [], 0
        if size:
            yield from part(held)

    def finished(block: int, total: np.ndarray):
        hottest = np.packbits(total >= hot).tobytes() if block < per_row else None
        return batch(
            block=pa.array([block], pa.int32()),
            repeated=pa.array([np.packbits(total >= 2).tobytes()], pa.binary()),
            hot=pa.array([hottest], pa.binary()),
        )

    def merged(batches):
        current, total = None, None
        for b in batches:
            for block, places, counts in zip(*(b.column(i).to_pylist() for i in range(3))):
                if block != current:
                    if current is not None:
                        yield finished(current, total)
                    current, total = block, np.zeros(1 << BLOCK_BITS, np.uint32)
                at = np.frombuffer(places, np.uint32)  # distinct within a part
                total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 1 << 30)
        if current is not None:
            yield finished(current, total)

    parts = df.mapInArrow(partition_sketches, "block int, places binary, counts binary")
    blocks = (
        parts.repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(merged, "block int, repeated binary, hot binary")
    )
    out = Sketch(width_bits)
    size = 1 << (BLOCK_BITS - 3)
    for row in blocks.toLocalIterator():  # at most DEPTH * per_row blocks of fixed size
        bits = slice((row.block % per_row) * size, (row.block % per_row + 1) * size)
        out.repeated[row.block // per_row, bits] = np.frombuffer(row.repeated, np.uint8)
        if row.hot is not None:
            out.hot[bits] = np.frombuffer(row.hot, np.uint8)
    return out
