"""Minimal perfect hashing of distinct 64-bit keys: levels of bit tables, ranks of their set bits, keys for verification."""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that is left, and levels after which keys are taken to repeat.
ROOM, MOST_LEVELS = 2, 64


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = (keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(32))) % np.uint64(size)


class PerfectHash:
    """``n`` keys to the numbers 0 to ``n - 1``; other keys are told apart by the keys stored in that order."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.levels, self.keys, self.ranks, before = levels, keys, [], 0
        for words in levels:
            ends = before + np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.ranks.append(np.concatenate(([before], ends)))
            before = int(ends[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """A key that is alone at its place of a level is settled by that bit; the others try the next level."""
        left, levels = keys.astype(np.uint64), []
        while len(left):
            if len(levels) == MOST_LEVELS:
                raise ValueError("the keys are not distinct")
            size = -(-ROOM * len(left) // 64) * 64
            places = _places(left, len(levels), size)
            times = np.bincount(places.astype(np.int64), minlength=size)
            levels.append(np.packbits(times == 1, bitorder="little").view(np.uint64))
            left = left[times[places.astype(np.int64)] > 1]
        made = cls(levels, np.zeros(len(keys), np.int64))
        made.keys[made._numbers(keys)] = keys
        return made

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        values = keys.astype(np.uint64)
        out, open_ = np.full(len(values), -1, np.int64), np.arange(len(values))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            places = _places(values[open_], level, 64 * len(words))
            word, bit = (places >> np.uint64(6)).astype(np.int64), places & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = ranks[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys``, -1 for those that are none of the hashed ones."""
        found = self._numbers(keys)
        if len(self.keys):
            found[self.keys[found] != keys] = -1
        return found
