"""SentencePiece BPE with offsets: every piece is traced back to the bytes of the source text that it stands for.

A text is normalised by the model's compiled character map (a double-array trie over bytes): at each place the longest
key that fits is replaced, a character without a key stays. While doing so the source offset of every normalised byte
is recorded; bytes of an unchanged stretch align one by one, all bytes of a replacement align with its beginning. Pieces
are merged on the normalised text and their ends looked up in that alignment. With an empty map and no literal
separator in the text the alignment is plain arithmetic, and no table of offsets is built.

Merging never crosses a pair of characters that stands side by side in no piece, so a text is cut before each run of
spaces, as no piece goes on after it. New words of a chunk of texts are merged together, in rounds over arrays, and
remembered (at most ``REMEMBERED`` of them a worker); long ones are cut at further such pairs and merged with a heap.

Defined results: null counts as empty; an empty text has the begin and the end id only, and decodes to an empty text. A
byte that is not UTF-8 is normalised to U+FFFD. Characters without a piece become one piece per byte. Repeated rows
are encoded each; extra columns do not matter; without rows there are none. Texts are encoded whole, in time that grows
with n log n even without any space. Begin and end ids have empty spans at the text's ends; the separator that
is put before the text has an empty span at 0. Pieces' spans do not overlap, and tile the text but for what the
normalisation deletes.

Models: byte-pair merges with byte fallback and escaped spaces, without user-defined pieces; others are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import batch, by_batch, prepare
from trackside.llm.textscan import chunks

MODEL = "piece_bpe_32k.model"
REMEMBERED = 1 << 17
LONGEST_REMEMBERED = 64
# Fixed values of the model file's format.
SEPARATOR = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
UNKNOWN_TEXT = " ⁇ "
REPLACEMENT = "�".encode()


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message, in order."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        if size is None:
            size = varint()
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: the size of the trie, its 32-bit units, and replacements that end with a zero byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``data`` has at this place."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        begin = found[1]
        return found[0], self.replacements[begin : self.replacements.index(0, begin)]


class Normaliser:
    def __init__(self, settings: bytes):
        spec = dict(fields(settings))
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.map = CharacterMap(spec.get(2, b""))
        self.plain = not self.map.units and not self.squeeze

    def parts(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Source offset, length and replacement of one stretch after the other."""
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map.units else None
            if hit is None:
                size = next((n for n in (1, 2, 3, 4) if valid(data[at : at + n])), 0)
                hit = (size, data[at : at + size]) if size else (1, REPLACEMENT)
            yield at, *hit
            at += hit[0]

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and for each of its bytes, and its end, the offset in ``data``."""
        out, align, gap = bytearray(), [], self.squeeze
        space = SEPARATOR.encode() if self.escape else b" "
        begun = False
        for at, size, text in self.parts(data):
            same = text == data[at : at + size]
            skip = len(text) - len(text.lstrip(b" ")) if gap else 0
            if skip < len(text) and not begun:
                begun = True
                if self.prefix:
                    out += space
                    align += [at if self.squeeze else 0] * len(space)
            for k in range(skip, len(text)):
                put = space if text[k] == 0x20 else text[k : k + 1]
                out += put
                align += [at + k if same else at] * len(put)
            if self.squeeze and skip < len(text):
                gap = text.endswith(b" ")
        align.append(len(data))
        while self.squeeze and out.endswith(space):
            del out[-len(space) :]
            del align[-len(space) :]
        return bytes(out), np.array(align, np.int64)


def valid(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


class Pieces:
    def __init__(self, serialised: bytes):
        self.text, self.kind, scores, settings, trainer = [], [], [], b"", {}
        for number, value in fields(serialised):
            if number == 1:
                piece = dict(fields(value))
                self.text.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kind.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                settings += value  # messages merge by appending
        self.normalise = Normaliser(settings)
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or not self.normalise.escape:
            raise ValueError("only BPE models with byte fallback and escaped spaces in front of words")
        if set(self.kind) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.begin_id, self.end_id = trainer.get(41, 1), trainer.get(42, 2)
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == NORMAL}
        self.cost = {t: -scores[i] for t, i in self.id.items()}
        byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == BYTE}
        self.byte_ids = [byte[b] for b in range(256)]
        self.together = {a + b for t in self.id for a, b in pairwise(t)}
        surface = {BYTE: lambda t: bytes([int(t[3:5], 16)]), CONTROL: lambda t: b"", UNKNOWN: lambda t: UNKNOWN_TEXT.encode()}
        self.surface = [surface.get(k, lambda t: t.replace(SEPARATOR, " ").encode())(t) for t, k in zip(self.text, self.kind)]
        self.width = np.array([len(s) for s in self.surface], np.int64)  # in the source, where a separator is one space
        self.long_width = np.array([1 if k == BYTE else len(t.encode()) for t, k in zip(self.text, self.kind)], np.int64)
        # Words carry the spaces before them; no piece has a separator after another character, or words are not cut.
        cuts = not any(SEPARATOR in t.lstrip(SEPARATOR) for t in self.id)
        self.words = re.compile(r" *[^ ]+| +" if cuts else r"[\s\S]+").findall
        self.control = np.array([k == CONTROL for k in self.kind])
        self.known: dict[str, bytes] = {}
        self.symbols_of()

    def merged(self, text: str) -> list[str]:
        """Pairs are merged by score, the leftmost of equal ones first, until none is a piece."""
        parts, cost, n = list(text), self.cost.get, len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (c := cost(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, text = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != text:
                continue  # one of the two has been merged since
            parts[i], parts[j] = text, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (c := cost(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (c, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def symbols_of(self) -> None:
        """Tables for merging many words at once: symbols are pieces, and characters that stand in pieces only."""
        symbol = dict(self.id)
        for c in sorted({c for t in self.id for c in t} - symbol.keys()):
            symbol[c] = len(self.text) + len(symbol)
        self.alone = {i: c for c, i in symbol.items() if i >= len(self.text)}
        self.base = 1 + max(symbol.values(), default=0)
        self.of_character = np.full(0x110000, -1, np.int64)
        for t, i in symbol.items():
            if len(t) == 1:
                self.of_character[ord(t)] = i
        splits = [(symbol[t[:k]], symbol[t[k:]], i) for t, i in self.id.items() for k in range(1, len(t)) if t[:k] in symbol and t[k:] in symbol]
        left, right, whole = np.array(splits or [(0, 0, 0)], np.int64).T
        order = np.argsort(left * self.base + right)
        self.pair, self.into = (left * self.base + right)[order], whole[order]
        _, rank = np.unique([self.cost.get(t, 0.0) for t in self.text], return_inverse=True)
        self.rank = np.append(rank, len(self.text))  # the last: no piece

    def learn(self, words: list[str]) -> None:
        """Remember the packed ids of words, spaces being separators: in each round every word merges its best pair."""
        texts = [w.replace(" ", SEPARATOR) for w in words]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        symbols = self.of_character[points]
        symbols = np.where(symbols < 0, -1 - points.astype(np.int64), symbols)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        none, done = len(self.text), []

        def merges(at: np.ndarray) -> np.ndarray:
            """The pieces that symbols at these places become with the next ones."""
            after = np.minimum(at + 1, len(symbols) - 1)
            a, b = symbols[at], symbols[after]
            key = a * self.base + b
            found = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            fits = (owner[at] == owner[after]) & (after > at) & (a >= 0) & (b >= 0) & (self.pair[found] == key)
            return np.where(fits, self.into[found], none)

        into = merges(np.arange(len(symbols)))
        while len(symbols):
            rank = self.rank[into]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            over = best == self.rank[none]
            done.append((owner[over], symbols[over]))
            hits = np.flatnonzero((rank == best) & ~over)
            hits = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])] if len(hits) else hits
            symbols[hits] = into[hits]
            stay = ~over
            stay[hits + 1] = False
            symbols, owner, into = symbols[stay], owner[stay], into[stay]
            hits = np.cumsum(stay)[hits] - 1
            for at in (hits, hits[hits > 0] - 1):
                into[at] = merges(at)
        owner = np.concatenate([o for o, _ in done])
        order = np.argsort(owner, kind="stable")
        symbols = np.concatenate([x for _, x in done])[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
        odd = np.zeros(len(texts), bool)
        odd[owner[order][(symbols < 0) | (symbols >= none)]] = True
        blob, low = symbols.astype("<u4").tobytes(), 0
        for word, high, bad in zip(words, ends.tolist(), odd.tolist()):
            self.known[word] = self.in_bytes(symbols[low:high].tolist()) if bad else blob[4 * low : 4 * high]
            low = high

    def in_bytes(self, symbols: list[int]) -> bytes:
        """Packed ids of symbols; those that are no piece become bytes."""
        ids: list[int] = []
        for i in symbols:
            if 0 <= i < len(self.text):
                ids.append(i)
            else:
                ids.extend(self.byte_ids[c] for c in (self.alone[i] if i >= 0 else chr(-1 - i)).encode())
        return np.array(ids, "<u4").tobytes()

    def long_word(self, text: str) -> bytes:
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.together), len(text)]
        ids: list[int] = []
        for a, b in pairwise(cuts):
            for piece in self.merged(text[a:b]):
                if (found := self.id.get(piece)) is not None:
                    ids.append(found)
                else:
                    ids.extend(self.byte_ids[c] for c in piece.encode())
        return np.array(ids, "<u4").tobytes()

    def packed(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts in which spaces are separators."""
        cut = [self.words(t) for t in texts]
        every = set().union(*cut)
        if len(self.known) + len(every) > REMEMBERED:
            self.known.clear()
        new = [w for w in every if w not in self.known and len(w) <= LONGEST_REMEMBERED]
        if new:
            self.learn(new)
        known = self.known
        long = {w: self.long_word(w.replace(" ", SEPARATOR)) for w in every if len(w) > LONGEST_REMEMBERED}
        both = known if not long else {**long, **{w: known[w] for w in every if w not in long}}
        return [np.frombuffer(b"".join([both[w] for w in words]), "<u4") for words in cut]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the ids, with the begin and the end id, and (begin, end) of each in the text's bytes."""
        ready: list[str] = []
        aligned: list[np.ndarray | None] = []
        for data in texts:
            try:
                text = data.decode() if self.normalise.plain else SEPARATOR
            except UnicodeDecodeError:
                text = SEPARATOR
            if SEPARATOR not in text:
                ready.append(" " + text if self.normalise.prefix and text else text)
                aligned.append(None)
            else:
                normal, align = self.normalise(data)
                ready.append(normal.decode().replace(SEPARATOR, " "))
                aligned.append(align)
        out = []
        for data, ids, align in zip(texts, self.packed(ready), aligned):
            spans = np.zeros((len(ids) + 2, 2), "<u4")
            if align is None:
                ends = np.cumsum(self.width[ids]) - int(self.normalise.prefix)
            else:
                ends = align[np.cumsum(self.long_width[ids])]
                spans[:2] = align[0]
            if len(ids):
                spans[1:-1, 1] = ends
                spans[2:-1, 0] = ends[:-1]
            spans[-1] = len(data)
            out.append((np.concatenate([[self.begin_id], ids, [self.end_id]]).astype("<u4"), spans))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: separators are spaces, the one in front goes; bytes that are not UTF-8 become U+FFFD each."""
        kind = self.kind
        listed = ids.tolist()
        whole = b"".join(map(self.surface.__getitem__, listed))
        first = next((i for i in listed if kind[i] != CONTROL), None)
        lead = first is not None and kind[first] == NORMAL and self.text[first].startswith(SEPARATOR)
        lead = lead and (self.normalise.prefix or self.normalise.squeeze)
        try:
            text = whole.decode() if not self.control[ids[1:-1]].any() else None
        except UnicodeDecodeError:
            text = None
        if text is None:
            text = "".join(self.decoded_runs(listed))
        if not lead:
            return text
        return text.lstrip(" ") if self.normalise.squeeze else text[1:]

    def decoded_runs(self, ids: list[int]) -> Iterator[str]:
        run = bytearray()
        for i in [*ids, self.end_id]:
            if self.kind[i] == BYTE:
                run += self.surface[i]
                continue
            at = 0
            while at < len(run):
                size = next((n for n in (1, 2, 3, 4) if valid(bytes(run[at : at + n]))), 0)
                yield run[at : at + size].decode() if size else "�"
                at += size or 1
            run.clear()
            yield self.surface[i].decode()


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        with open(path, "rb") as file:
            _LOADED[path] = Pieces(file.read())
    return _LOADED[path]


def public_model(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def in_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per document: id_col, ids and spans (little-endian unsigned 32-bit numbers; spans are begin, end, begin, ...),
    decoded. ``model`` is the path of a model file on every machine, the public one by default."""
    prepare(docs.sparkSession)

    def run(b: pa.RecordBatch):
        use = loaded(model or public_model())
        texts = [t or b"" for t in b.column(1).to_pylist()]
        for low, high in chunks(texts):
            ids, spans, decoded = [], [], []
            for found, where in use.encode(texts[low:high]):
                ids.append(found.tobytes())
                spans.append(where.tobytes())
                decoded.append(use.decode(found))
            yield batch(
                did=b.column(0).slice(low, high - low), ids=pa.array(ids, pa.binary()), spans=pa.array(spans, pa.binary()),
                decoded=pa.array(decoded, pa.string()),
            )

    rows = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return by_batch(rows, run, "did long, ids binary, spans binary, decoded string").withColumnRenamed("did", id_col)


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of ids, and SHA-256 of ids, decoded text and spans."""
    return pieces.select(
        F.col(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("spans", 256).alias("spans_sha256"),
    )
