"""A minimal perfect hash of 64-bit keys, built and looked up in numpy.

Level by level, keys hash into a bit array of about GAMMA bits a key; a key alone on its bit is settled there and
the others go on to the next level. A key's number is the count of set bits before its own, over all levels.
What LEVELS leave over (none, but for bad luck) is kept as a sorted list.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 2.0, 40


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 finalizer over keys moved by the seed."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 ... n - 1 for n different keys; any number, or -1, for other keys."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, rest: np.ndarray):
        self.words, self.sizes, self.rest = words, sizes, rest
        before = np.cumsum(np.bitwise_count(words).astype(np.int64))
        self.before = np.concatenate([[0], before])
        self.first_word = np.concatenate([[0], np.cumsum(sizes // 64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, words, sizes = keys.astype(np.int64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-int(GAMMA * len(left)) // 64) * 64 or 64
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(sizes, np.int64), np.sort(left))

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = (mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            word = self.first_word[level] + at // 64
            bit = np.uint64(1) << (at % 64).astype(np.uint64)
            hit = (self.words[word] & bit) != 0
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(self.words[word[hit]] & (bit[hit] - np.uint64(1)))
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.searchsorted(self.rest, keys[left]).clip(max=len(self.rest) - 1)
            found = self.rest[at] == keys[left]
            out[left[found]] = self.before[-1] + at[found]
        return out
