"""N-gram Jaccard self-join with signature trees.

Documents are sets of word shingles; two link when ``100 * |A & B| >= threshold * |A | B|``. The result is exact.

1. Equal sets are one class, represented by its smallest id; copies are never paired with each other.
2. Blocks. Linked sets differ in at most D shingles, D from their sizes, so when shingles are dealt by hash to D + c
   non-empty groups, c groups are equal in both; small sets have a group per shingle. Each set sends the hashes of its groups, for its own size
   level and, near the upper end, for the next one. (A set whose shingles happen to fill too few groups also sends the
   empty ones: two such sets have c equal groups among all.) Sets with enough equal groups are connected (see
   :func:`candidate_edges`); what is connected forms a block. Nothing outside a block can link to it.
3. Signature trees. In a block every set has a token bitmap; nodes hold the OR of their bitmaps, the size range and the
   most shingles that any of their sets loses to shared bits. Two nodes are traversed together and dropped when even the largest possible
   overlap is too small, or when all their sets are connected already. Pairs of sets that remain are compared exactly.
4. Blocks above ``BLOCK_SHINGLES`` are cut by size and hash. Each part is joined in itself, then one set per component
   found, then the parts against each other, except where both are within one component: a large group of near
   copies collapses to one component early and is not compared pair by pair.
5. Components of the links; component_id is the smallest id in it.

Null text or too few words: no shingle or one, see :func:`shingle_sets`; an empty set links with nothing. Null ids
count as the largest id and come back as null. Rows that share an id are one node of the link graph.
Other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackside.llm.anchors import LAST_ID, keyed, spread
from trackside.llm.common import batch, components, few, in_arrow, may_contain, prepare, signed, stored, unsigned, unused
from trackside.llm.textscan import chunks, encoded, gram_hashes, mix, scan_words

SHINGLE = 4
THRESHOLD = 85
BLOCK_SHINGLES = 400_000
KEYS_PER_FLUSH = 2_000_000
PAIRED = 32
RARE_SHARE = 4
SMALL = 40
FANOUT = 8
HUB_ROUNDS = 4
MOST_BITS = 1 << 14


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one after the other; and their numbers.

    Words are lower-cased (A-Z). A text with fewer words than a shingle has one shingle, all its words;
    without words it has none.
    """
    words = scan_words(texts, lower=True)
    hashes = gram_hashes(words.hashes, shingle)
    inside = np.flatnonzero(words.whole_runs(shingle))
    owner, value = words.owner[inside], hashes[inside]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        whole = [gram_hashes(words.hashes[words.first[i] : words.first[i + 1]], count[i])[0] for i in short]
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, mix(np.array(whole, np.uint64) + count[short].astype(np.uint64))])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


def set_digests(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    ends = np.cumsum(sizes)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(salt)), out=sums[1:])
        out.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)))
    return out[0], out[1]


def level_bounds(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size levels: first size, groups a set is dealt to (0: a group per shingle), groups linked sets have in common.

    |A ^ B| <= (100 - t) / (100 + t) * (|A| + |B|) = D, with both sizes up to the end of the level of the larger one. Small
    sets have a group per shingle, hence at least t percent of the level's first size in common.
    """
    first = [1]
    while first[-1] < 1 << 40 and len(first) < 62:
        first.append(max(first[-1] + 1, int(first[-1] * max(1.42, 100 / threshold))))
    start = np.array(first, np.int64)
    differ = 2 * (np.append(start[1:], start[-1] * 2) - 1) * (100 - threshold) // (100 + threshold)
    common = np.where(start < SMALL, -(-start * threshold // 100), 1 + differ // 6)
    return start, np.where(start < SMALL, 0, differ + common), common


def group_keys(values, sizes, nodes, threshold: int):
    """(key, node): linked sets with different contents have at least the level's number of keys in common.

    A key has its level in the highest six bits. With D + c groups filled, D of which may differ, c are equal.
    """
    start, filled_at, _ = level_bounds(threshold)
    for step in (0, 1):
        level = np.maximum(np.searchsorted(start, sizes, side="right") - 1, 0) + step
        use = sizes > 0
        if step:  # may be the smaller of a pair whose larger is on the next level
            use &= 100 * sizes >= threshold * start[level]
        each = use & (filled_at[level] == 0)
        if each.any():
            owner = np.repeat(np.arange(len(sizes)), sizes)
            used = each[owner]
            token, owner = values[used], owner[used]
            top = level[owner].astype(np.uint64)
            yield mix(token + top) >> np.uint64(6) | top << np.uint64(58), nodes[owner]
        use &= ~each
        if not use.any():
            continue
        filled_least = filled_at[level]
        groups = np.where(use, filled_least + filled_least // 32 + 1, 0)
        base = np.cumsum(groups) - groups
        owner = np.repeat(np.arange(len(sizes)), sizes)
        used = use[owner]
        token, owner = values[used], owner[used]
        salted = mix(token + level[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        slot = base[owner] + (salted % groups[owner].astype(np.uint64)).astype(np.int64)
        total = np.zeros(groups.sum(), np.uint64)
        np.add.at(total, slot, mix(token ^ np.uint64(0xA0761D6478BD642F)))
        filled = np.bincount(slot, minlength=len(total)) > 0
        owner = np.repeat(np.arange(len(sizes)), groups)
        few = np.bincount(owner[filled], minlength=len(sizes)) < filled_least
        sent = np.flatnonzero(filled | few[owner])
        owner = owner[sent]
        name = (level[owner].astype(np.uint64) << np.uint64(40)) + (sent - base[owner]).astype(np.uint64)
        key = mix(total[sent] + mix(name)) >> np.uint64(6)
        yield key | (level[owner].astype(np.uint64) << np.uint64(58)), nodes[owner]


def _groups(key, node):
    """Distinct (key, node) in order, where groups of a key begin, their sizes, and which hold a marked node."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (node[1:] >> np.uint64(1) != node[:-1] >> np.uint64(1))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    marked = np.maximum.reduceat(node & np.uint64(1), first) > 0
    key, node = key[keep], node[keep] & ~np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key, node, first, np.diff(np.append(first, len(key))), marked


def candidate_edges(rows: DataFrame, sizes: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """(a, b): set digests that share enough keys. ``sizes``: (node, n) of all sets.

    A set of n shingles differs from a linked one in at most n (100 - t) / t of them, so it shares c keys or more, c from n.
    Of these at least x (the level's least c / ``RARE_SHARE``) are in few sets (at most ``PAIRED``), or more than c - x are
    frequent. Pairs are counted within the former. From frequent keys, a set takes part if it has m = c - x + 1 of
    them; two that share m share one of the rarest F - m + 1 of each, F being its number of them, and only by these it is connected to
    the key's smallest. So sets with a common passage stay apart, and the number of rows stays in proportion to the sets. A task
    that finds a key frequent sends its sets past the key's partition, with one row, marked in its lowest bit, that tells it.
    """
    _, _, common_at = level_bounds(threshold)
    rare_at = np.maximum(common_at // RARE_SHARE, 1)
    one = np.uint64(1)

    def reduced(held):
        key, node, first, size, _ = _groups(*(np.concatenate(x) for x in zip(*held)))
        large = np.repeat(size > PAIRED, size)
        yield batch(slot=signed(key[~large]), key=signed(key[~large]), node=signed(node[~large]))
        if large.any():
            yield batch(slot=signed(mix(key[large] + node[large])), key=signed(key[large]), node=signed(node[large]))
            tell = first[size > PAIRED]
            yield batch(slot=signed(key[tell]), key=signed(key[tell]), node=signed(node[tell] | one))

    def keys(batches):
        held, n = [], 0
        for b in batches:
            texts = encoded(b.column(0).to_pylist())
            for i, j in chunks(texts):
                values, sizes = shingle_sets(texts[i:j], shingle)
                nodes, _ = set_digests(values, sizes)
                for x in group_keys(values, sizes, nodes & ~one, threshold):
                    held.append(x)
                    n += len(x[0])
                if n >= KEYS_PER_FLUSH:
                    yield from reduced(held)
                    held, n = [], 0
        if n:
            yield from reduced(held)

    def counted(batches):
        """worth > 0: sets a and b share keys; worth 0: a is a frequent key, b one of its sets."""
        held = []
        for b in batches:
            slot, key, node = (unsigned(np.asarray(b.column(i))) for i in range(3))
            past = slot != key
            if past.any():
                yield batch(a=signed(key[past]), b=signed(node[past]), worth=np.zeros(past.sum()))
            held.append((key[~past], node[~past]))
        if not sum(len(k) for k, _ in held):
            return
        key, node, first, size, marked = _groups(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        level = np.minimum(key[first] >> np.uint64(58), len(common_at) - 1).astype(np.int64)
        worth = 1.0 / rare_at[level]
        frequent = marked | (size > PAIRED)
        if frequent.any():
            every = spread(first[frequent], size[frequent])
            yield batch(a=signed(key[every]), b=signed(node[every]), worth=np.zeros(len(every)))
        found = []
        for m in range(2, PAIRED + 1):
            these = np.flatnonzero((size == m) & ~frequent)
            if len(these):
                x, y = np.triu_indices(m, 1)
                at = first[these][:, None]
                found.append((node[at + x].ravel(), node[at + y].ravel(), np.repeat(worth[these], len(x))))
        if found:
            a, b, w = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((b, a))
            a, b, w = a[order], b[order], w[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield batch(a=signed(a[new]), b=signed(b[new]), worth=np.add.reduceat(w, new))

    sent = in_arrow(rows.select("text"), keys, "slot long, key long, node long")
    shared = stored(in_arrow(sent.repartition("slot"), counted, "a long, b long, worth double"), "keys")
    pairs = shared.where("worth > 0").groupBy("a", "b").agg(F.sum("worth").alias("worth"))
    pairs = few(pairs.where("worth > 0.999999").select("a", "b"))
    frequent = few(shared.where("worth = 0").select(F.col("a").alias("key"), F.col("b").alias("node")).distinct())
    level = F.shiftrightunsigned("key", 58)
    _, filled_at, _ = level_bounds(threshold)
    tables = {name: F.array(*[F.lit(int(v)) for v in values]) for name, values in (("filled", filled_at), ("common", common_at), ("rare", rare_at))}
    filled, common, rare = (tables[k][F.col("level").cast("int")] for k in tables)
    differ = F.least(filled - common, F.floor(F.col("size_of") * (100 - threshold) / threshold))
    need = F.when(filled == 0, F.greatest(common, F.ceil(F.col("size_of") * threshold / 100))).otherwise(filled - differ)
    often = few(frequent.groupBy("node", level.alias("level")).agg(F.count(F.lit(1)).alias("n")))
    often = few(often.where(F.col("n") > common - rare).join(sizes.groupBy("node").agg(F.max("n").alias("size_of")), "node"))
    often = often.select("node", "level", "n", (need - rare + 1).alias("enough")).where("n >= enough")
    spread_of = few(frequent.groupBy("key").agg(F.count(F.lit(1)).alias("size")))
    held = few(few(frequent.withColumn("level", level).join(often, ["node", "level"])).join(spread_of, "key"))
    nth = F.row_number().over(Window.partitionBy("node", "level").orderBy("size", "key"))  # at most the groups of a set
    left = few(held.withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.col("enough") + 1).select("key", "node"))
    stars = few(left.join(few(left.groupBy("key").agg(F.min("node").alias("least"))), "key")).select(
        F.col("least").alias("a"), F.col("node").alias("b")
    )
    return pairs.unionByName(stars)


class Union:
    """Components of the sets of one task."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)


class Tree:
    """Signature tree over sets: ``levels[0]`` has a node per set, the last level one root."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        words = bits // 64
        maps = np.zeros((len(sets), words), np.uint64)
        for row, s in zip(maps, sets):
            at = (s >> np.uint64(20)) % np.uint64(bits)
            np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        size = np.array([len(s) for s in sets])
        lost = size - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, size, size, lost)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, lost = self.levels[-1]
            cuts = np.arange(0, len(maps), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts),
                np.maximum.reduceat(high, cuts), np.maximum.reduceat(lost, cuts),
            ))

    def labels(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and largest component label below each node, by level."""
        out = [(label, label)]
        for level in self.levels[:-1]:
            cuts = np.arange(0, len(level[0]), FANOUT)
            out.append((np.minimum.reduceat(out[-1][0], cuts), np.maximum.reduceat(out[-1][1], cuts)))
        return out


def possible(one, two, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Which node pairs may hold a link: by sizes, then by the largest overlap their bitmaps allow."""
    ok = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        i, j = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        fit = 100 * np.minimum(one[2][i], two[2][j]) >= threshold * np.maximum(one[1][i], two[1][j])
        k = np.flatnonzero(fit)
        most = np.bitwise_count(one[0][i[k]] & two[0][j[k]]).sum(1) + np.minimum(one[3][i[k]], two[3][j[k]])
        most = np.minimum(most, np.minimum(one[2][i[k]], two[2][j[k]]))
        fit[k] = (100 + threshold) * most >= threshold * (one[1][i[k]] + two[1][j[k]])
        ok[at : at + len(i)] = fit
    return ok


def traverse(one: Tree, two: Tree, union: Union, offset: int, threshold: int):
    """Pairs of sets (i in ``one``, j in ``two``) that may link and are not connected; ``offset``: where the
    labels of ``two`` begin; the trees are the same object for a self-join."""
    self_join = one is two
    la, lb = len(one.levels) - 1, len(two.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def children(tree, level, x):
        n = len(tree.levels[level - 1][0])
        kids = x[:, None] * FANOUT + np.arange(FANOUT)
        return kids, kids < n

    while True:
        low = one.labels(union.label[: len(one.levels[0][0])])[la]
        high = low if self_join and la == lb else two.labels(union.label[offset : offset + len(two.levels[0][0])])[lb]
        connected = (low[0][a] == low[1][a]) & (high[0][b] == high[1][b]) & (low[0][a] == high[0][b])
        a, b = a[~connected], b[~connected]
        keep = possible(one.levels[la], two.levels[lb], a, b, threshold)
        a, b = a[keep], b[keep]
        if not la and not lb:
            if self_join:
                a, b = a[a < b], b[a < b]
            return a, b
        if la >= lb and la:
            kids, there = children(one, la, a)
            next_a, other = kids[there], np.broadcast_to(b[:, None], kids.shape)[there]
            a, b, la = next_a, other, la - 1
            if self_join:  # both sides have the same depth: go down on the other side too
                kids, there = children(two, lb, b)
                a, b, lb = np.broadcast_to(a[:, None], kids.shape)[there], kids[there], lb - 1
                a, b = a[a <= b], b[a <= b]
        else:
            kids, there = children(two, lb, b)
            a, b, lb = np.broadcast_to(a[:, None], kids.shape)[there], kids[there], lb - 1


def joined_block(sets: list[np.ndarray], label: np.ndarray, split: int, threshold: int) -> list[tuple[int, int]]:
    """Links that connect the components of a block's sets (not every link).

    ``label``: components known before. ``split``: 0 for a self-join, else sets before it are joined with those from it.
    """
    union, links = Union(label), []
    size = np.array([len(s) for s in sets])

    def check(i, j):
        if union.label[i] != union.label[j]:
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= threshold * (size[i] + size[j] - common):
                union.join(i, j)
                links.append((i, j))

    if not split:
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        lonely = np.ones(len(sets), bool)
        for _ in range(HUB_ROUNDS if len(sets) > 2 else 0):  # one set against all at once
            hub = int(np.argmax(lonely))
            if not lonely[hub]:
                break
            lonely[hub] = False
            place = np.minimum(np.searchsorted(sets[hub], token), size[hub] - 1)
            common = np.bincount(owner[sets[hub][place] == token], minlength=len(sets))
            for j in np.flatnonzero(100 * common >= threshold * (size[hub] + size - common)):
                lonely[j] = False
                if union.label[hub] != union.label[j]:
                    union.join(hub, int(j))
                    links.append((hub, int(j)))
    bits = 256
    while bits < MOST_BITS and bits < 8 * size.max():
        bits *= 2
    if not split:
        tree = Tree(sets, bits)
        pairs = traverse(tree, tree, union, 0, threshold)
    else:
        pairs = traverse(Tree(sets[:split], bits), Tree(sets[split:], bits), union, split, threshold)
    for i, j in zip(*(x.tolist() for x in pairs)):
        check(i, j + split)
    return links


def block_links(members: DataFrame, by: list[str], shingle: int, threshold: int) -> DataFrame:
    """(a, b) ids of verified links that connect each group of ``members`` (did, side, comp, n, text).

    Sides 0 only: a self-join. Sides 0 and 1: one against the other.
    """

    def solve(rows):
        rows.sort(key=lambda r: (r[1], r[3], r[0]))
        sets = []
        texts = encoded(r[4] for r in rows)
        for i, j in chunks(texts):
            values, sizes = shingle_sets(texts[i:j], shingle)
            sets += np.split(values, np.cumsum(sizes)[:-1])
        split = sum(r[1] == 0 for r in rows)
        comp = np.unique([r[2] for r in rows], return_inverse=True)[1]
        found = joined_block(sets, comp, split if split < len(rows) else 0, threshold)
        if found:
            yield batch(a=pa.array([rows[i][0] for i, _ in found], pa.int64()), b=pa.array([rows[j][0] for _, j in found], pa.int64()))

    def run(batches):
        now, held = None, []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns):
                group = row[5:]
                if group != now:
                    if len(held) > 1:
                        yield from solve(held)
                    now, held = group, []
                held.append(row[:5])
        if len(held) > 1:
            yield from solve(held)

    dealt = members.select("did", "side", "comp", "n", "text", *by).repartition(*by).sortWithinPartitions(*by)
    return in_arrow(dealt, run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Per row: id_col, n_shingles, component_id."""
    return classified(docs, id_col, text_col, shingle, threshold, block_shingles).select(
        F.when(F.col("did") != LAST_ID, F.col("did")).alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("component") != LAST_ID, F.col("component")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id, columns as they are."""
    found = stored(classified(docs, id_col, text_col, shingle, threshold, BLOCK_SHINGLES).drop("n"), "kinds")
    # Only rows that may go, or may be repeated, are shuffled with their texts.
    other = (F.col("component") != F.col("did")) | (F.col("first_th") != F.col("th"))
    counted = found.groupBy("did", "th").agg(F.max(other).alias("goes"), F.count(F.lit(1)).alias("n"))
    unsure = stored(counted.where(F.col("goes") | (F.col("n") > 1)), "unsure")
    did, th, nth = unused(docs, "did", "th", "nth")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(did, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))).withColumn(th, F.xxhash64(text))
    hit = may_contain(unsure.select("did"))(did)
    goes = unsure.where("goes").select(F.col("did").alias(did), F.col("th").alias(th))
    left = rows.where(hit).join(goes.hint("shuffle_hash"), [did, th], "left_anti")
    left = left.withColumn(nth, F.row_number().over(Window.partitionBy(did, th).orderBy(did))).where(F.col(nth) == 1)
    return rows.where(~hit).select(*docs.columns).unionByName(left.select(*docs.columns))


def classified(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int, block_shingles: int
) -> DataFrame:
    """did, th, n, component and first_th of every row. Links are between sets of shingles, whatever the ids of their rows;
    a component's row of the smallest (did, th) gives component and first_th."""
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)

    def describe(batches):
        for b in batches:
            texts = encoded(b.column(2).to_pylist())
            for i, j in chunks(texts):
                values, sizes = shingle_sets(texts[i:j], shingle)
                h1, h2 = set_digests(values, sizes)
                part = slice(i, j)
                yield batch(
                    did=b.column(0)[part], th=b.column(1)[part], n=pa.array(sizes, pa.int64()), h1=signed(h1), h2=signed(h2)
                )

    info = stored(in_arrow(rows, describe, "did long, th long, n long, h1 long, h2 long"), "sets")
    classes = info.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("did", "th")).alias("rep"))
    classes = stored(few(classes).select("h1", "h2", "n", F.xxhash64("h1", "h2", "n").alias("set"), "rep.did", "rep.th"), "classes")
    node = F.col("h1").bitwiseAND(F.lit(-2)).alias("node")
    blocks = components(candidate_edges(rows, classes.select(node, "n"), shingle, threshold), "blocks")

    in_block = F.col("h1").bitwiseAND(F.lit(-2)) == F.col("node")
    members = few(classes.join(blocks.select("node", F.col("component").alias("block")), in_block)).drop("node")
    weight = members.groupBy("block").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    # Parts of large blocks: sizes within 8 percent, then by hash to about block_shingles each.
    bin_of = F.when(F.col("all_n") <= block_shingles, 0).otherwise(F.floor(F.log(F.col("n")) / F.log(F.lit(1.08))))
    members = few(members.join(few(weight), "block")).withColumn("bin", bin_of.cast("long"))
    bins = few(members.groupBy("block", "bin").agg(F.sum("n").alias("bin_n")))
    members = members.join(bins, ["block", "bin"]).withColumn(
        "part", F.when(F.col("all_n") <= block_shingles, 0).otherwise(
            F.pmod(F.xxhash64("did", "th"), F.ceil(F.col("bin_n") / block_shingles))
        ).cast("long"),
    )
    members = stored(few(members), "in-blocks")
    members = stored(
        rows.where(may_contain(members.select("did"))("did")).join(members, ["did", "th"]).select(
            "block", "bin", "part", F.col("set").alias("did"), "n", (F.col("all_n") > block_shingles).alias("large"), "text"
        ),
        "members",
    ).withColumn("side", F.lit(0))
    links = stored(block_links(members.withColumn("comp", F.col("did")), ["block", "bin", "part"], shingle, threshold), "links")

    large = members.where("large")
    if large.limit(1).count():
        links = links.unionByName(large_blocks(large, links, shingle, threshold, block_shingles))
    final = components(links, "linked").select(F.col("node").alias("set"), "component")
    by_class = classes.join(final, "set", "left").withColumn("component", F.coalesce("component", "set"))
    by_class = stored(few(by_class.select("h1", "h2", "n", "did", "th", "component")), "by-class")
    smallest = by_class.groupBy("component").agg(F.min(F.struct("did", "th")).alias("first"))
    by_class = few(by_class.select("h1", "h2", "n", "component").join(smallest, "component")).select("h1", "h2", "n", "first")
    out = info.join(by_class, ["h1", "h2", "n"], "left")
    first = F.coalesce("first", F.struct("did", "th"))
    return out.select("did", "th", "n", first["did"].alias("component"), first["th"].alias("first_th"))


def large_blocks(large: DataFrame, links: DataFrame, shingle: int, threshold: int, block_shingles: int) -> DataFrame:
    """More links for blocks cut into parts: between components' first sets, then between parts."""

    def labelled(now: DataFrame, label: str) -> DataFrame:
        found = components(now, label).select(F.col("node").alias("did"), F.col("component").alias("comp"))
        return large.join(found, "did", "left").withColumn("comp", F.coalesce("comp", "did"))

    first = labelled(links, "parts")
    hubs = first.groupBy("block", "comp").agg(F.min_by(F.struct("did", "n", "text"), "did").alias("hub"))
    hubs = hubs.select("block", "comp", "hub.did", "hub.n", "hub.text", F.lit(0).alias("side"))
    hubs = hubs.withColumn("bin", F.floor(F.log(F.col("n")) / F.log(F.lit(1.08))))
    many = hubs.groupBy("block", "bin").agg(F.sum("n").alias("hub_n"))
    hubs = hubs.join(many, ["block", "bin"]).withColumn(
        "part", F.pmod(F.xxhash64("did"), F.ceil(F.col("hub_n") / block_shingles))
    )
    more = stored(links.unionByName(block_links(hubs, ["block", "bin", "part"], shingle, threshold)), "hub-links")

    # Sets outside their block's largest component, and parts that lie within it: the latter need no comparison.
    second = labelled(more, "hubs").drop("text")
    counts = second.groupBy("block", "comp").agg(F.sum("n").alias("comp_n"))
    main = counts.groupBy("block").agg(F.max_by("comp", "comp_n").alias("main"))
    second = second.join(main, "block").withColumn("rest", F.col("comp") != F.col("main"))
    sizes = second.groupBy("block", "bin", "rest").agg(F.sum("n").alias("bin_n"))
    second = second.join(sizes, ["block", "bin", "rest"]).withColumn(
        "part", F.pmod(F.xxhash64("did"), F.ceil(F.col("bin_n") / block_shingles))
    )
    second = second.withColumn("node", F.xxhash64("block", "bin", "rest", "part"))
    second = stored(few(second.select("block", "did", "n", "comp", "rest", "node")), "parts")
    nodes = second.groupBy("block", "node", "rest").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c1"), F.max("comp").alias("c2")
    )
    x, y = nodes.alias("x"), nodes.alias("y")
    pairs = x.join(y, F.col("x.block") == F.col("y.block")).where(
        (F.col("x.node") <= F.col("y.node"))
        & (F.col("x.rest") | F.col("y.rest"))
        & (100 * F.least("x.high", "y.high") >= threshold * F.greatest("x.low", "y.low"))
        & ~((F.col("x.c1") == F.col("x.c2")) & (F.col("y.c1") == F.col("y.c2")) & (F.col("x.c1") == F.col("y.c1")))
    ).select(F.col("x.node").alias("left"), F.col("y.node").alias("right"))
    sides = pairs.select("left", "right", F.col("left").alias("node"), F.lit(0).alias("side")).unionByName(
        pairs.where("left <> right").select("left", "right", F.col("right").alias("node"), F.lit(1).alias("side"))
    )
    tasks = second.join(sides, "node").join(large.select("block", "did", "n", "text"), ["block", "did", "n"])
    return more.unionByName(block_links(tasks, ["left", "right"], shingle, threshold))
