"""Repair of conversations with a minimal, audited list of edits.

A repaired conversation's roles begin with at most one system turn and then alternate user and assistant, ending with the
assistant: ``(s?(ua)+)?`` in initials. Edits per row are K (keep, 0), R (give it the role user or assistant, 2) and D (delete,
3); I (insert an empty turn, 2) may stand anywhere. Blank and duplicate rows must go; a truncated row that stays costs 1 more.
Of the cheapest audits (the edits' initials in order) the least in ASCII order is taken.

The dynamic program keeps one audit for each of four states of that pattern. Audits are persistent: a node is one edit
with its parent, so alternatives share their prefixes. Every node has its ancestors at distances of powers of two and a rolling
hash of its audit; equal costs are decided by the longest common prefix of two audits, found by jumping from the
ends to the last place where hashes differ. The two nodes there must have one parent, else hashes have collided and the audits
are compared edit by edit. As the state after an audit is determined by its edits, no audit is a prefix of another of the
same cost, so the best continuation of the best prefix is the best audit.

Rows are sorted by conversation and turn over ranges, so that a long conversation spreads over many tasks. A task
turns its share of a conversation that may go on elsewhere into pieces of at most ``PIECE_ROWS`` rows: the best audit from
each state to each state. The pieces of a conversation are then combined in order; what is common to the audits of all states is
settled and leaves the comparison. Conversations inside one task, nearly all, are finished there. A digest of the repaired text
is sequential by nature: for split conversations a task streams the texts past it and holds one audit, a byte a row.

Defined results: null role and text are one space; null turns come first; null conversation ids form one conversation. Rows of
one turn are ordered by role and the SHA-256 of their text. A row's first fault counts: blank (white space only), duplicate (role and text
stood earlier in the conversation), truncated (the last visible character is not one of ``.!?``). Repeated rows are duplicates.
``gaps`` counts turn numbers missing between the least and the greatest; it saturates at a long. Texts are never cut. Ids without any
row are given as ``conversations`` and have zeros, an empty audit and the digest of an empty text. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import prepare, stored

PIECE_ROWS = 4_096
PIECE_BYTES = 4 << 20
SPACES = " \t\n\v\f\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # fixed costs
# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by an inserted or renamed turn
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
MODULUS, FACTOR = (1 << 61) - 1, 0x1F3D5B79
LONG = (1 << 63) - 1


class Audits:
    """Audits as linked nodes; 0 is the empty one."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... edits before
        self.collisions = 0

    def add(self, parent: int, edit: str) -> int:
        node, up, k = len(self.edit), [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * FACTOR + ord(edit)) % self.modulus)
        self.up.append(up)
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def shortened(self, node: int, depth: int) -> int:
        while (over := self.depth[node] - depth) > 0:
            node = self.up[node][over.bit_length() - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        depth = min(self.depth[a], self.depth[b])
        x, y = self.shortened(a, depth), self.shortened(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        if self.hash[x] != self.hash[y]:
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            if self.up[x][0] == self.up[y][0] and self.edit[x] != self.edit[y]:
                return self.edit[x] < self.edit[y]
        self.collisions += 1
        return self.text(a) < self.text(b)


Best = list[tuple[int, int] | None]  # cost and audit by state


def offer(audits: Audits, best: Best, state: int, cost: int, parent: int, edit: str) -> None:
    have = best[state]
    if have is None or cost < have[0]:
        best[state] = cost, audits.add(parent, edit)
    elif cost == have[0]:
        node = audits.add(parent, edit)
        if audits.less(node, have[1]):
            best[state] = cost, node


def with_inserts(audits: Audits, best: Best) -> Best:
    """Two in a row at most help: from the start, or from system, to assistant."""
    best = list(best)
    for state in (START, SYSTEM, ASSISTANT, USER):
        if best[state] is not None:
            offer(audits, best, NEXT[state], best[state][0] + INSERT, best[state][1], "I")
    return best


def solved(rows: list[tuple[str, str, str]], start: int, audits: Audits) -> Best:
    """From a state over rows of (role, text, fault), without inserts after the last row."""
    best: Best = [None] * 4
    best[start] = 0, 0
    for role, _, fault in rows:
        before, best = with_inserts(audits, best), [None] * 4
        extra = TRUNCATED if fault == "truncated" else 0
        for state, have in enumerate(before):
            if have is None:
                continue
            cost, node = have
            offer(audits, best, state, cost + DELETE, node, "D")
            if fault in ("blank", "duplicate"):
                continue
            if (to := KEPT.get((state, role[:1]))) is not None:
                offer(audits, best, to, cost + extra, node, "K")
            offer(audits, best, NEXT[state], cost + REROLE + extra, node, "R")
    return best


def fault_of(text: str, first: bool) -> str:
    visible = text.rstrip(SPACES)
    if not visible:
        return "blank"
    if not first:
        return "duplicate"
    return "" if visible[-1] in ENDS else "truncated"


@dataclass
class Piece:
    """Consecutive rows of one conversation."""

    rows: list[tuple[str, str, str]] = field(default_factory=list)
    size: int = 0
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    illegal: int = 0

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        if self.rows and self.rows[-1][0][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.rows.append((role, text, fault_of(text, first)))
        self.size += len(text)

    def full(self, most_rows: int) -> bool:
        return len(self.rows) >= most_rows or self.size >= PIECE_BYTES

    def summary(self, starts=range(4)) -> dict:
        faults = [f for *_, f in self.rows]
        audits, costs, texts = Audits(), [], []
        for start in range(4):
            best = solved(self.rows, start, audits) if start in starts else [None] * 4
            costs += [b and b[0] for b in best]
            texts += [b and audits.text(b[1]) for b in best]
        return {
            "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": self.illegal, "low": self.low, "high": self.high, "distinct": self.distinct,
            "head": self.rows[0][0][:1] if self.rows else None, "tail": self.rows[-1][0][:1] if self.rows else None,
            "costs": costs, "audits": texts,
        }


class Whole:
    """Pieces of a conversation, in order, as one."""

    def __init__(self):
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.tail = None
        self.distinct = 0
        self.settled: list[str] = []
        self.best: list[tuple[int, str] | None] = [(0, ""), None, None, None]

    def add(self, piece: dict) -> None:
        for name in self.count:
            self.count[name] += piece[name]
        if piece["head"] is not None:
            if self.tail is not None and self.tail + piece["head"] not in LEGAL:
                self.count["illegal"] += 1
            self.tail = piece["tail"]
        if piece["low"] is not None:
            self.distinct += piece["distinct"] - (self.high == piece["low"])
            self.low, self.high = piece["low"] if self.low is None else self.low, piece["high"]
        best: list[tuple[int, str] | None] = [None] * 4
        for start, have in enumerate(self.best):
            for end in range(4):
                cost = piece["costs"][4 * start + end]
                if have is not None and cost is not None:
                    new = have[0] + cost, have[1] + piece["audits"][4 * start + end]
                    if best[end] is None or new < best[end]:
                        best[end] = new
        same = len(os.path.commonprefix([b[1] for b in best if b]))
        self.settled.append(next(b[1] for b in best if b)[:same])
        self.best = [b and (b[0], b[1][same:]) for b in best]

    def result(self) -> dict:
        ends = [(START, ""), (ASSISTANT, ""), (USER, "I"), (SYSTEM, "II")]
        cost, tail = min((self.best[s][0] + INSERT * len(more), self.best[s][1] + more) for s, more in ends if self.best[s])
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, LONG)
        return {"gaps": gaps, **self.count, "cost": cost, "audit": "".join(self.settled) + tail}


class Digest:
    """SHA-256 of the repaired text, row by row along an audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.lines = audit, 0, START, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.sha.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self.line(ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            self.line(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.line(ROLE[self.state], text)

    def hex(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


RESULT = [
    ("conv", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
]
PIECES = [
    ("part", pa.int32()), ("piece", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()), ("head", pa.string()),
    ("tail", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())),
]
SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}


def sql_schema(columns) -> str:
    return ", ".join(f"{n} {SQL[t]}" for n, t in columns)


def in_batches(rows: Iterator[dict], columns, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Small batches: one with bodies ends when it is as large as a piece."""
    ready, size, schema = [], 0, pa.schema(columns)
    for row in rows:
        ready.append(row)
        size += len(row.get("audit") or "") + sum(map(len, row.get("texts") or ()))
        if len(ready) >= most_rows or size >= PIECE_BYTES:
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready, size = [], 0
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


def finished(conv: int | None, piece: Piece) -> dict:
    """The result of a conversation that is one piece."""
    whole = Whole()
    whole.add(piece.summary((START,)))
    result = whole.result()
    digest = Digest(result["audit"])
    for role, text, _ in piece.rows:
        digest.row(role, text)
    return {"conv": conv, **result, "repaired_sha256": digest.hex()}


def conversations_of(batches, piece_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to finished conversations and pieces of those that may go on in other tasks."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[dict]:
        now, begun, number, piece, marked = None, False, 0, None, None

        def cut() -> dict:
            body = {"roles": [r for r, *_ in piece.rows], "texts": [t for _, t, _ in piece.rows]}
            return {"conv": now, "part": part, "piece": number, **piece.summary(), **body}

        for b in batches:
            for conv, lead, turn, role, sha, text, n in zip(*(c.to_pylist() for c in b.columns)):
                if piece is None or conv != now:
                    if piece is not None:  # another one follows, so this one ends here
                        yield finished(now, piece) if begun and not number else cut()
                    now, begun, number, piece, marked = conv, False, 0, Piece(), None
                if not lead:
                    begun = True
                elif not n:
                    marked = turn, role, sha
                else:
                    for k in range(n):
                        if piece.full(piece_rows):
                            yield cut()
                            number, piece = number + 1, Piece()
                        piece.add(turn, role, text, k == 0 and marked == (turn, role, sha))
        if piece is not None:
            yield cut()

    yield from in_batches(rows(), RESULT + PIECES)


def combined(batches) -> Iterator[pa.RecordBatch]:
    """Pieces in order to results without the digest."""

    def rows() -> Iterator[dict]:
        now, whole = None, None
        for b in batches:
            for r in b.to_pylist():
                if whole is None or r["conv"] != now:
                    if whole is not None:
                        yield {"conv": now, **whole.result()}
                    now, whole = r["conv"], Whole()
                whole.add(r)
        if whole is not None:
            yield {"conv": now, **whole.result()}

    yield from in_batches(rows(), RESULT)


def digested(batches) -> Iterator[pa.RecordBatch]:
    """A result, then the bodies of its pieces in order."""

    def rows() -> Iterator[dict]:
        result, digest = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["piece"] is None:
                    if result is not None:
                        yield {**result, "repaired_sha256": digest.hex()}
                    result, digest = {n: r[n] for n, _ in RESULT}, Digest(r["audit"])
                else:
                    for role, text in zip(r["roles"], r["texts"]):
                        digest.row(role, text)
        if result is not None:
            yield {**result, "repaired_sha256": digest.hex()}

    yield from in_batches(rows(), RESULT)


def repaired(
    df: DataFrame,
    conversations: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """One row per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``conversations``: ids (its first column) that have a result even without rows.
    """
    prepare(df.sparkSession)
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv"), F.lit(1).alias("lead"), F.col(turn_col).cast("long").alias("turn"),
        either(role_col).alias("role"), either(text_col).alias("text"),
    ).withColumn("sha", F.unhex(F.sha2("text", 256)))
    # Repeated rows become one with a count; a row of its own says where a role and text stand first.
    merged = rows.groupBy("conv", "lead", "turn", "role", "sha").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("n"))
    firsts = rows.groupBy("conv", "lead", "role", "sha").agg(F.min(F.struct("turn")).alias("at"))
    firsts = firsts.select("conv", "lead", F.col("at.turn").alias("turn"), "role", "sha", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    ids = rows.select("conv")
    if conversations is not None:
        ids = ids.unionAll(conversations.select(F.col(conversations.columns[0]).cast("long").alias("conv")))
    heads = ids.distinct().selectExpr("conv", "0 AS lead", "CAST(NULL AS LONG) AS turn", "'' AS role", "X'' AS sha", "CAST(NULL AS STRING) AS text", "0L AS n")
    every = heads.unionByName(firsts).unionByName(merged).select("conv", "lead", "turn", "role", "sha", "text", "n")
    place = ["conv", "lead", "turn", "role", "sha"]
    dealt = every.repartitionByRange(*place).sortWithinPartitions(*place, "n")
    found = stored(dealt.mapInArrow(lambda batches: conversations_of(batches, piece_rows), sql_schema(RESULT + PIECES)), "conversations")
    names = [n for n, _ in RESULT]
    split = found.where(F.col("piece").isNotNull())
    order = ["conv", "part", "piece"]
    results = (
        split.drop("roles", "texts").repartition("conv").sortWithinPartitions(*order).mapInArrow(combined, sql_schema(RESULT))
    )
    empty = {n: F.lit(None).cast(SQL[t]) for n, t in PIECES if n in ("part", "piece", "roles", "texts")}
    bodies = split.select(*names, *empty).unionByName(results.withColumns(empty))
    last = bodies.repartition("conv").sortWithinPartitions(*order).mapInArrow(digested, sql_schema(RESULT))
    return found.where(F.col("piece").isNull()).select(*names).unionByName(last).withColumnRenamed("conv", conv_col)
