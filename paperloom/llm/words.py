"""Words of many texts at once, by array steps: places, hashes, and a table to look them up in."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: Bytes of words that are hashed at once.
SPAN = 1 << 18
#: Longer words are hashed one by one.
LONG_WORD = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A word is a run of other bytes.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd number modulo 2**64, of its inverse, and a number for each byte."""

    def __init__(self, base: int = 0x9FB21C651E98DF25):
        inverse = np.array([base, pow(base, -1, 1 << 64)], np.uint64)
        table = np.ones((2, SPAN + 1), np.uint64)
        table[:, 1:] = inverse[:, None]
        self.up, self.down = np.cumprod(table, axis=1)
        self.byte = mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)


@lru_cache(maxsize=1)
def _powers() -> _Powers:
    return _Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of each word of ``data``; the hash depends on the word's bytes alone."""
    cells = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_BLANK[cells], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, span_hashes(data, starts, ends)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the ascending spans, which depends on its bytes alone.

    It is the difference of two prefix sums of a polynomial over the bytes, shifted
    back by the inverse power of where the span starts.
    """
    cells = np.frombuffer(data, np.uint8)
    out = np.zeros(len(starts), np.uint64)
    powers, low = _powers(), 0
    while low < len(starts):
        high = max(int(np.searchsorted(ends, starts[low] + SPAN, "right")), low + 1)
        first = int(starts[low])
        span = cells[first : int(ends[high - 1])]
        if len(span) <= SPAN:
            sums = np.zeros(len(span) + 1, np.uint64)
            np.cumsum(powers.byte[span] * powers.up[: len(span)], out=sums[1:])
            a, b = starts[low:high] - first, ends[low:high] - first
            out[low:high] = (sums[b] - sums[a]) * powers.down[a] + (b - a).astype(np.uint64)
        low = high
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[int(starts[k]) : int(ends[k])])
    return mixed(out)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of the texts joined by one space, and each text's number of words."""
    starts, ends, hashes = word_hashes(b" ".join(texts))
    stops = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return starts, ends, hashes, np.diff(np.searchsorted(starts, stops), prepend=0)


class Lookup:
    """Numbers of 64-bit hashes without repeats, in the order they came; an open table of four to eight times their number."""

    def __init__(self, hashes: np.ndarray):
        self.size = 0
        self._make(len(hashes))
        self.add(hashes)

    def _make(self, room: int) -> None:
        bits = max(4, room.bit_length() + 2)
        self.room, self.shift = 1 << bits - 2, np.uint64(64 - bits)
        self.hashes = np.zeros(self.room + 1, np.uint64)
        self.table = np.full((1 << bits) + self.room + 1, -1, np.int32)

    def add(self, hashes: np.ndarray) -> None:
        """Give numbers to hashes that have none yet."""
        if self.size + len(hashes) > self.room:
            before = self.hashes[: self.size]
            self._make(2 * (self.size + len(hashes)))
            self.size = 0
            self.add(before)
        todo = np.arange(self.size, self.size + len(hashes), dtype=np.int32)
        self.hashes[todo] = hashes
        self.size += len(hashes)
        slot = (hashes >> self.shift).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.table[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            self.table[slot[free[one]]] = todo[free[one]]
            left = self.table[slot] != todo
            todo, slot = todo[left], slot[left] + 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it has none."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = self.table[slot]
        wrong = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        while len(wrong):
            slot[wrong] += 1
            out[wrong] = self.table[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.hashes[out[wrong]] != hashes[wrong])]
        return out
