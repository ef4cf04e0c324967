"""A minimal perfect hash over 128-bit keys in numpy.

Keys that fall alone on a bit of a level's bit array are placed there;
the others go on to the next level.  A key's number is the rank of its
bit, so ``n`` keys get the numbers 0 to n-1 and no key is stored.  A key
that was not built in gets no number or a wrong one: compare a
fingerprint.
"""

from __future__ import annotations

import numpy as np

#: Bits per key on each level.
LOAD = 1.5
#: Levels before building gives up; distinct keys need far fewer.
MAX_LEVELS = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mix(mix(high + step) ^ low) % np.uint64(size)


class MinimalHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        """``sizes``: bits of each level (multiples of 64); ``words``: all bits, 64 in a word."""
        self.sizes, self.words = sizes, words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> MinimalHash:
        sizes, parts = [], []
        for level in range(MAX_LEVELS):
            if not len(high):
                break
            size = (int(len(high) * LOAD) // 64 + 1) * 64
            at = place(high, low, level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = ~alone[at]
            high, low = high[rest], low[rest]
        if len(high):
            raise ValueError("keys are not distinct")
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level holds it."""
        out = np.full(len(high), -1, dtype=np.int64)
        left, base = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = place(high[left], low[left], level, size)
            word = base + (at >> np.uint64(6)).astype(np.int64)
            bit = at & np.uint64(63)
            held = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[held]] & ((np.uint64(1) << bit[held]) - np.uint64(1))
            out[left[held]] = self.ranks[word[held]] + np.bitwise_count(below)
            left, base = left[~held], base + size // 64
        return out
