"""Mixture-controlled packing: deficit round-robin over one queue of tokens per source.

Every window (sequence of ``length`` tokens) takes from each source its share of the window; what a share misses or
exceeds by rounding to whole tokens is that source's deficit and is carried to the next window. The carry has a closed form:
of the first x tokens, one half of the sources gets its share rounded down, the other half the rest, and so on within
each half. Every source's count only ever grows, a deficit stays below 1 + log2(sources) tokens, and every task knows the
state at any window without seeing the ones before. Deficits so carry across windows and partitions alike.

Targets default to the sources' own shares of all tokens, which empties all queues together: every window but the
last is full. With other targets the mix holds until a queue is empty and goes on with the rest in proportion.

A document is its ids and the end id; it is cut where a source's turn in a window ends. Documents of a source
queue up as their rows are read; running sums are kept per task while tokenising, and a table of one row per task
and source says where each task's part of a queue begins.

Null text counts as empty (one piece, the end id); a null source is a queue of its own, last in code point order.
Repeated rows are packed each. Extra columns do not matter. Without rows there is no sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackside.llm.common import batch, in_arrow, prepare, stored

LENGTH = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k"
LONG = 10000
LONG_RUN = re.compile(rf"\S{{{LONG}}}|\s{{{LONG}}}")


class Encoder:
    """Ids of texts by a public vocabulary.

    The rank file of the same vocabulary gives the same ids several times faster than the JSON file; texts with
    very long runs, or with a special token's string, go through the JSON file's tokenizer, which gives that token's id.
    """

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.json = public_tokenizers.path(f"{name}.json")
        self.slow = None
        with open(self.json, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def careful(self, text: str) -> bool:
        return any(t in text for t in self.special) or len(text) >= LONG and LONG_RUN.search(text) is not None

    def ids(self, text: str) -> list[int]:
        if not self.careful(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json)
        return self.slow.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


@dataclass
class Phase:
    """A stretch of the output with one mix: ``begin`` is its first token; of queue j it takes the tokens from
    ``base[j]``, ``sums[j + 1] - sums[j]`` of them."""

    begin: int
    base: list[int]
    sums: list[int]

    def given(self, j: int, x: int) -> int:
        """Tokens of the queues before j among the first x."""
        low, high, before = 0, len(self.sums) - 1, 0
        while low < j < high:
            middle = (low + high) // 2
            whole = self.sums[high] - self.sums[low]
            left = x * (self.sums[middle] - self.sums[low]) // whole if whole else 0
            if j < middle:
                high, x = middle, left
            else:
                low, before, x = middle, before + left, x - left
        return before + (x if j >= high else 0)


class Schedule:
    def __init__(self, tokens: list[int], weights: list[float] | None, length: int):
        """``tokens``: in each queue; ``weights``: target proportions, None for the queues' own."""
        self.length, self.phases = length, []
        left, base, begin = list(tokens), [0] * len(tokens), 0
        weights = [float(n) for n in tokens] if weights is None else weights
        while sum(left):
            active = [j for j, n in enumerate(left) if n and weights[j] > 0] or [j for j, n in enumerate(left) if n]
            share = {j: weights[j] if weights[j] > 0 else 1.0 for j in active}
            first = min(active, key=lambda j: left[j] / share[j])
            rounds = left[first] / share[first]
            take = [min(left[j], round(rounds * share[j])) if j in share else 0 for j in range(len(left))]
            take[first] = left[first]
            sums = [0]
            for n in take:
                sums.append(sums[-1] + n)
            self.phases.append(Phase(begin, list(base), sums))
            begin += sums[-1]
            base = [b + n for b, n in zip(base, take)]
            left = [n - m for n, m in zip(left, take)]
        self._ends = [[p.base[j] + p.sums[j + 1] - p.sums[j] for p in self.phases] for j in range(len(tokens))]

    def pieces(self, j: int, at: int, n: int):
        """(start, length, sequence, offset) of the pieces of tokens at .. at+n of queue j."""
        done = 0
        while done < n:
            k = bisect_right(self._ends[j], at + done)
            p = self.phases[k]
            total, own = p.sums[-1], p.sums[j + 1] - p.sums[j]
            place = at + done - p.base[j]
            window = (p.begin + place * total // own) // self.length
            while True:
                low = min(max(window * self.length - p.begin, 0), total)
                high = min(max((window + 1) * self.length - p.begin, 0), total)
                before, after = p.given(j, low), p.given(j, high)
                first, last = p.given(j + 1, low) - before, p.given(j + 1, high) - after
                if place < first:
                    window -= 1
                elif place >= last:
                    window += 1
                else:
                    break
            size = min(last - place, n - done)
            offset = max(p.begin - window * self.length, 0) + (after - before) + place - first
            yield done, size, window, offset
            done += size


def tokenised(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """did, queue, part, at (tokens of the queue before, within the part), n, ids (32-bit, little-endian)."""
    queue = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    rows = docs.select(F.col(id_col).cast("long").alias("did"), queue.alias("queue"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        use, part, running = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for b in batches:
            ids, at, n = [], [], []
            for queue, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = use.ids(text)
                found.append(end_id)
                ids.append(np.array(found, "<u2" if max(found) < 65536 else "<u4").tobytes())
                at.append(running.get(queue, 0))
                n.append(len(found))
                running[queue] = at[-1] + n[-1]
            yield batch(
                did=b.column(0), queue=b.column(1), part=pa.array([part] * len(n), pa.int32()), at=pa.array(at, pa.int64()),
                n=pa.array(n, pa.int64()), ids=pa.array(ids, pa.binary()),
            )

    return stored(in_arrow(rows, run, "did long, queue string, part int, at long, n long, ids binary"), "tokens")


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length: int = LENGTH,
    weights: dict[str | None, float] | None = None,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``weights``: target proportion by source; a source without one comes after the others.
    """
    prepare(docs.sparkSession)
    tokens = tokenised(docs, id_col, text_col, source_col, tokenizer, end_id)
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("part_n"))
    in_queue = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_n").over(in_queue), F.lit(0))).drop("part_n")
    # One row per source.
    sizes = {r.queue: r.n for r in tokens.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    queues = sorted(sizes)
    shares = None if weights is None else [float(weights.get(None if q == "1" else q[1:], 0)) for q in queues]
    schedule = Schedule([sizes[q] for q in queues], shares, length)
    number = {q: j for j, q in enumerate(queues)}

    def cut(batches):
        for b in batches:
            columns = [[] for _ in range(8)]
            for did, queue, at, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                for start, size, window, offset in schedule.pieces(number[queue], at, n):
                    crc = zlib.crc32(ids[start : start + size])
                    for c, v in zip(columns, (did, start, size, crc, n, window, offset, None if queue == "1" else queue[1:])):
                        c.append(v)
            kinds = [pa.int64()] * 7 + [pa.string()]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    placed = tokens.join(parts, ["queue", "part"]).select("did", "queue", (F.col("at") + F.col("before")).alias("at"), "n", "ids")
    return in_arrow(
        placed,
        cut,
        f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string",
    )
