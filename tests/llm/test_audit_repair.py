"""Repaired conversations against exhaustive search, SQL and a plain dynamic program."""

import hashlib
import itertools
import random
import re

import pytest

from trackside.llm import audit_repair
from trackside.llm.audit_repair import Audits, Piece, Whole, repaired, solved

SCHEMA = "conv_id long, turn long, role string, text string, conv long, n string, lead int"
SPACES = " \t\n\v\f\r"


def ordered(rows):
    """Rows of one conversation with their faults."""
    rows = sorted(
        ((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda a: (a[0] is not None, a[0] or 0, a[1].encode(), hashlib.sha256(a[2].encode()).digest()),
    )
    seen, out = set(), []
    for turn, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def after_edit(lines, edit, row):
    """The repaired lines after an edit, or None where the pattern forbids it."""
    roles = "".join(role[:1] for role, _ in lines)
    follow = "a" if roles.endswith("u") else "u"
    if edit == "D":
        return lines
    if edit == "K":
        role = row[1]
        return [*lines, (role, row[2])] if role[:1] == follow or (not roles and role[:1] == "s") else None
    return [*lines, ({"u": "user", "a": "assistant"}[follow], "" if edit == "I" else row[2])]


def plain(rows):
    """Strings instead of nodes: all that reach a row are kept by the roles so far's pattern."""
    best = {0: (0, "", [])}

    def state(lines):
        roles = "".join(r[:1] for r, _ in lines)
        return 0 if not roles else {"s": 1, "u": 2, "a": 3}[roles[-1]]

    def grow(pool, edits, row):
        out = {}
        for cost, audit, lines in pool:
            for edit, price in edits:
                if row and edit != "D" and row[3] in ("blank", "duplicate"):
                    continue
                new = after_edit(lines, edit, row)
                if new is not None:
                    extra = 1 if row and row[3] == "truncated" and edit != "D" else 0
                    option = (cost + price + extra, audit + edit, new)
                    s = state(new)
                    out[s] = min(out.get(s, option), option)
        return out

    def inserted(pool):
        every = dict(pool)
        for _ in range(4):
            for s, option in grow(every.values(), [("I", 2)], None).items():
                every[s] = min(every.get(s, option), option)
        return every

    for row in rows:
        best = grow(inserted(best).values(), [("D", 3), ("K", 0), ("R", 2)], row)
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def exhaustive(rows):
    found = []
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            audit = "".join("I" * n + e for n, e in zip(inserts, [*edits, ""]))
            lines, cost, at = [], 0, 0
            for edit in audit:
                row = rows[at] if edit != "I" else None
                at += edit != "I"
                if row and edit != "D" and row[3] in ("blank", "duplicate"):
                    lines = None
                else:
                    lines = after_edit(lines, edit, row)
                if lines is None:
                    break
                cost += {"K": 0, "R": 2, "D": 3, "I": 2}[edit] + (1 if row and row[3] == "truncated" and edit != "D" else 0)
            if lines is not None and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)):
                found.append((cost, audit, lines))
    return min(found)


def wanted(conv, raw, search=plain):
    rows = ordered(raw)
    turns = [t for t, *_ in rows if t is not None]
    faults = [f for *_, f in rows]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, lines = search(rows)
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (
        conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
        faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def random_conversation(rnd, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["yes.", "no!", "well", "", " \t", "why? ", None, "é.", "end\n"]
    return [(rnd.choice([None, rnd.randint(0, n + 2), k]), rnd.choice(roles), rnd.choice(texts)) for k in range(n)]


def test_plain_program_is_right():
    rnd = random.Random(1)
    for _ in range(40):
        rows = random_conversation(rnd, rnd.randint(0, 4))
        assert wanted(1, rows) == wanted(1, rows, exhaustive)


@pytest.mark.parametrize("modulus", [audit_repair.MODULUS, 5, 1])
def test_nodes_against_strings(modulus):
    """Also where hashes collide all the time."""
    rnd, collisions = random.Random(2), 0
    for _ in range(150):
        rows = ordered(random_conversation(rnd, rnd.randint(0, 25)))
        audits = Audits(modulus)
        best = solved([r[1:] for r in rows], 0, audits)
        ends = audit_repair.with_inserts(audits, best)
        have = min((b[0], audits.text(b[1])) for s, b in enumerate(ends) if b and s in (0, 3))
        assert have == plain(rows)[:2]
        collisions += audits.collisions
    assert (collisions > 0) == (modulus != audit_repair.MODULUS)


def test_comparison_by_common_prefix():
    rnd, audits = random.Random(3), Audits()
    nodes = [0]
    for _ in range(3000):
        nodes.append(audits.add(rnd.choice(nodes[-20:]), rnd.choice("DIKR")))
    for _ in range(3000):
        a, b = rnd.choice(nodes), rnd.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def test_pieces_combine():
    rnd = random.Random(4)
    for _ in range(60):
        raw = random_conversation(rnd, rnd.randint(1, 40))
        rows, whole, piece, seen = ordered(raw), Whole(), Piece(), set()
        for turn, role, text, _ in rows:
            if rnd.random() < 0.3:
                whole.add(piece.summary())
                piece = Piece()
            piece.add(turn, role, text, (role, text) not in seen)
            seen.add((role, text))
        whole.add(piece.summary())
        got = whole.result()
        assert (1, *got.values()) == wanted(1, raw)[:-1]


def conversations(seed, n, longest):
    rnd = random.Random(seed)
    out = {c: random_conversation(rnd, rnd.randint(1, 9)) for c in [None, *range(n)]}
    out[n] = [(t, rnd.choice(["user", "assistant"]), f"text {t % 50}.") for t in range(longest)]
    out[n + 1] = [(3, "user", "the same.")] * (longest // 2)
    return out


@pytest.mark.parametrize("rows_in_piece", [4096, 7])
def test_same_as_plain(spark, rows_in_piece):
    all_of = conversations(5, 60, 400)
    rows = [(c, t, r, x, 9, "z", 1) for c, conv in all_of.items() for t, r, x in conv]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ids = spark.createDataFrame([(c,) for c in [*all_of, 1000]], "id long")
    got = sorted(map(tuple, repaired(df, ids, piece_rows=rows_in_piece).collect()), key=str)
    want = [wanted(c, conv) for c, conv in all_of.items()] + [(1000, *[0] * 6, "", hashlib.sha256().hexdigest())]
    assert got == sorted(want, key=str)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repaired(empty).collect() == []
    alone = repaired(spark.createDataFrame([(None, None, None, None, 1, "", 1)], SCHEMA)).collect()
    assert [tuple(r)[:8] for r in alone] == [(None, 0, 1, 0, 0, 0, 3, "D")]
