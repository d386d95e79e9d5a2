"""The Jaccard join against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from trackside.llm.signature_join import Tree, group_keys, joined_block, near_duplicates, one_of_each, shingle_sets, traverse, Union

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(a, b, threshold):
    return bool(a and b) and 100 * len(a & b) >= threshold * len(a | b)


def brute(rows, threshold=85, n=4):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if linked(a, b, threshold):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.fixture(scope="module")
def near(words):
    """Chains of edits, so that links and components differ; many sizes; equal sets in other order of words."""
    rnd = random.Random(9)
    rows, number = [], 0
    for _ in range(30):
        text = rnd.choices(words, k=rnd.choice([5, 6, 8, 12, 30, 90, 200]))
        for _ in range(rnd.randint(1, 8)):
            rows.append((number, " ".join(text)))
            number += 1
            text = list(text)
            for _ in range(rnd.randint(0, 2)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
    return rows


@pytest.mark.parametrize("block", [400_000, 300])
def test_components(spark, near, block):
    docs = spark.createDataFrame(near, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, block_shingles=block).collect()}
    assert got == brute(near)


def test_odd_rows(spark, odd, odd_rows):
    rows = {r[0]: r[1] for r in odd_rows if r[0] is not None and r[0] != 41}
    want = brute(sorted(rows.items()))
    got = near_duplicates(odd.where("doc_id <> 41")).collect()
    assert len(got) == sum(r[0] is not None and r[0] != 41 for r in odd_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert near_duplicates(odd).count() == len(odd_rows)


def test_one_stays(spark, near, odd):
    docs = spark.createDataFrame(near, "doc_id long, text string")
    want = {i for i, (_, c) in brute(near, 80, 5).items() if i == c}
    assert {r.doc_id for r in one_of_each(docs).collect()} == want
    twice = spark.createDataFrame([(70, "a text that nobody else has at all", "en", "a", 7, 0.5, 3, "x", 1, "y")] * 2, odd.schema)
    kept = one_of_each(odd.unionByName(twice))
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 70").count() == 1
    assert kept.where("doc_id in (30, 31, 32, 40)").count() == 0  # texts of smaller ids


def test_nothing(nothing):
    assert near_duplicates(nothing).collect() == []
    assert one_of_each(nothing).collect() == []


def test_linked_sets_share_keys():
    """Enough of them, for every size, at the very edge of the threshold."""
    from trackside.llm.signature_join import level_bounds

    rng = np.random.default_rng(2)
    _, _, common_at = level_bounds(85)
    for size in [*range(6, 60), 99, 100, 101, 255, 256, 600, 3000]:
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        most = next(k for k in range(size, -1, -1) if 100 * (size - k) >= 85 * (size + k))
        b = np.concatenate([a[most:], rng.integers(0, 1 << 63, most, dtype=np.uint64)])
        fewer = a[: next(n for n in range(1, size + 1) if 100 * n >= 85 * size)]
        for other in (b, fewer):
            if len(other) == size and most == 0:
                continue
            keys = [set(), set()]
            both = (np.concatenate([a, other]), np.array([size, len(other)]), np.array([0, 1], np.uint64))
            for key, node in group_keys(*both, 85):
                for k, n in zip(key.tolist(), node.tolist()):
                    keys[n].add(k)
            worth = max(sum(k >> 58 == level for k in keys[0] & keys[1]) / common_at[level] for level in range(62))
            assert worth > 0.999999, size


def test_traversal_finds_every_link(words):
    rnd = random.Random(3)
    texts = []
    for _ in range(25):
        base = rnd.choices(words, k=60)
        for _ in range(3):
            base = list(base)
            base[rnd.randrange(60)] = rnd.choice(words)
            texts.append(" ".join(base).encode())
    values, sizes = shingle_sets(texts, 4)
    sets = np.split(values, np.cumsum(sizes)[:-1])
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if linked(set(sets[i]), set(sets[j]), 85)}
    tree = Tree(sets, 512)
    got = set(zip(*(x.tolist() for x in traverse(tree, tree, Union(np.arange(len(sets))), 0, 85))))
    assert want <= got
    left, right = Tree(sets[:30], 512), Tree(sets[30:], 512)
    cross = traverse(left, right, Union(np.arange(len(sets))), 30, 85)
    assert {(i, j) for i, j in want if i < 30 <= j} <= {(i, j + 30) for i, j in zip(*(x.tolist() for x in cross))}
    neighbours = defaultdict(set)
    for i, j in joined_block(sets, np.arange(len(sets)), 0, 85):
        assert (min(i, j), max(i, j)) in want
        neighbours[i].add(j)


def test_rows_without_ids_or_with_one_id(spark, words):
    """Links are between texts: rows without an id, or under one id, are neither linked by it nor kept apart."""
    rnd = random.Random(12)
    text = [" ".join(rnd.choices(words, k=60)) for _ in range(8)]
    near = [t + " tail" for t in text]
    rows = [(1, text[0]), (None, near[0]), (None, text[1]), (None, text[2]), (None, text[3]), (None, near[3])]
    rows += [(2, text[4]), (9, near[4]), (9, text[5]), (8, text[6]), (8, near[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.text for r in one_of_each(docs).collect()}
    assert {text[0], text[1], text[2], text[4], text[5]} <= got and not {near[0], near[4]} & got
    assert len(got & {text[3], near[3]}) == 1 and len(got & {text[6], near[6]}) == 1 and len(got) == 7
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(docs, shingle=5, threshold=80).collect())
    assert found == sorted([(1, 1), (0, 1)] + [(0, 0)] * 4 + [(2, 2), (9, 2), (9, 9), (8, 8), (8, 8)])
