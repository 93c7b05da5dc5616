"""Words of many texts at once, as 64-bit hashes, with numpy on their UTF-8 bytes.

All separators are ASCII, so bytes of longer characters always belong to words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def separators(pattern: str) -> np.ndarray:
    table = np.zeros(256, bool)
    if pattern == "space":  # \x20 \x09-\x0D
        table[[0x20, *range(0x09, 0x0E)]] = True
    elif pattern == "ascii":  # all ASCII but letters and digits
        table[:128] = True
        table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
    else:
        raise ValueError(pattern)
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


_powers: dict[str, np.ndarray] = {}


def _powers_to(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; one table of each is kept, as long as was needed."""
    n = 1 << bits
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(n, base, U64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of consecutive texts: ``hashes[bounds[i]:bounds[i + 1]]`` are those of text i."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def words_of(data: np.ndarray, offsets: np.ndarray, pattern: str, lower: bool) -> Words:
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none.astype(U64), np.zeros(len(offsets), np.int64), none, none, data)
    if lower:
        data = LOWER[data]
    inside = ~separators(pattern)[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    starts = np.flatnonzero(inside & (before | fresh[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    ends = np.flatnonzero(inside & (after | fresh[1:])) + 1
    up, down = _powers_to(max(16, int(n).bit_length()))
    terms = (data.astype(U64) + U64(1)) * up[:n]
    sums = np.zeros(n + 1, U64)
    np.cumsum(terms, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; k - 1 fewer than the words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for i in range(k):
        total = total * U64(_BASE) + hashes[i : i + n]
    return mix(total)
