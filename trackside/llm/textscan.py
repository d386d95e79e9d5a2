"""Vectorised scanning of UTF-8 text: words, n-gram hashes, sliding minima.

Texts are joined into one byte buffer of bounded size and every step is one numpy pass over it, so
that no Python statement runs per word. A word is a run of bytes other than space and 0x09-0x0D;
those bytes never occur inside a multi-byte code point, so byte runs are the words of the text.

Hashes are polynomials modulo 2**64 over random byte weights, taken from prefix sums (all
multipliers are odd, hence invertible) and finished with a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 512 << 10  # texts are scanned in chunks of about this size; a longer text is a chunk of its own
_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WEIGHT = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        made = np.full(size, base, np.uint64)
        made[0] = 1
        have = np.multiply.accumulate(made)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def forget() -> None:
    """Drop the tables of powers, which grow with the longest chunk."""
    _POWERS.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def gram_hashes(values: np.ndarray, n: int, base: int = _Q) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive values (empty if there are fewer)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values, base)
    return mix((sums[n:] - sums[:-n]) * powers(inverse(base), len(values) - n + 1))


def byte_weights(data: np.ndarray) -> np.ndarray:
    return _WEIGHT[data]


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of its smallest value, the leftmost of equal ones.

    By doubling: the minimum of 2k values is the better of two minima of k values.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        a, b = at[: len(at) - span], at[span:]
        at, span = np.where(values[b] < values[a], b, a), span * 2
    if span < width:
        a, b = at[:n], at[width - span : width - span + n]
        at = np.where(values[b] < values[a], b, a)
    return at[:n]


@dataclass
class Words:
    """The words of several texts. ``first[i]:first[i+1]`` are the words of text ``i``."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def whole_runs(self, n: int) -> np.ndarray:
        """For each start of ``n`` words in the joined buffer: do they lie in one text?"""
        owner = self.owner
        return owner[: len(owner) - n + 1] == owner[n - 1 :] if len(owner) >= n else np.zeros(0, bool)


def scan_words(texts: list[bytes], lower: bool = False) -> Words:
    """``lower`` turns A-Z into a-z first."""
    joined = b"\n".join(texts)
    if lower:
        joined = joined.translate(_LOWER)
    data = np.frombuffer(joined, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    begin = np.flatnonzero(space[:-2] & ~space[1:-1])
    end = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    sums = prefix_sums(_WEIGHT[data], _P)
    inv = powers(inverse(_P), len(data) + 1)
    hashes = mix((sums[end] - sums[begin]) * inv[begin] + (end - begin).astype(np.uint64))
    return Words(data, begin, end, np.searchsorted(begin, starts), hashes)


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
