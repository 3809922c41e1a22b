"""Word shingles and one-permutation sketches of UTF-8 texts as numpy vectors."""

from __future__ import annotations

import numpy as np

WORDS_PER_SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(2 * len(_powers), n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)], dtype=np.uint64)
            _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE, np.uint64)], dtype=np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, in order.

    Prefix sums of byte times power give every word's polynomial at once; the inverse power shifts it to
    the word's own start.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    _grow(len(raw))
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[raw], out=inside[1:-1].view(bool))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _inverses[starts])


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; with fewer words, of the whole sequence."""
    words = word_hashes(data)
    n = len(words) - WORDS_PER_SHINGLE + 1
    if not len(words):
        return words
    if n < 1:
        return mixed((words * _PLACES[: len(words)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(words)))
    total = words[:n] * _PLACES[0]
    for k in range(1, WORDS_PER_SHINGLE):
        total += words[k : n + k] * _PLACES[k]
    return np.unique(mixed(total))


class OnePermutation:
    """Sketches of sorted 64-bit sets: the least value of each of 2**bits bins, empty bins densified.

    One hash per element decides both its bin (high bits) and its rank in it. An empty bin borrows from the
    first non-empty bin in a pseudo-random order of its own, the same order for every set, which makes the
    chance that two sketches agree in a bin equal to the sets' Jaccard similarity (optimal densification).
    """

    AT_ONCE = 32

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.size = 1 << bits
        self._tries = self._picks(0, self.AT_ONCE)

    def _picks(self, first: int, n: int) -> np.ndarray:
        at = np.arange(self.size, dtype=np.uint64)[:, None] << np.uint64(32)
        tried = np.arange(first, first + n, dtype=np.uint64)[None, :]
        return (mixed(at + tried + np.uint64(0x51ED270B)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def sketch(self, ordered: np.ndarray) -> np.ndarray:
        """Values per bin; ``ordered`` must be sorted, distinct and not empty."""
        bins = (ordered >> np.uint64(64 - self.bits)).astype(np.int64)
        first = np.r_[0, np.flatnonzero(bins[1:] != bins[:-1]) + 1]
        taken = bins[first]
        if len(taken) == self.size:
            return ordered[first]
        values = np.zeros(self.size, np.uint64)
        values[taken] = ordered[first]
        filled = np.zeros(self.size, bool)
        filled[taken] = True
        empty = np.flatnonzero(~filled)
        tries, done = self._tries, self.AT_ONCE
        while len(empty):
            asked = tries[empty]
            good = filled[asked]
            at = good.argmax(1)
            rows = np.arange(len(empty))
            found = good[rows, at]
            values[empty[found]] = values[asked[rows, at][found]]
            empty = empty[~found]
            if len(empty):
                tries = self._picks(done, self.AT_ONCE)
                done += self.AT_ONCE
        return values
