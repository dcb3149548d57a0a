"""Minimal perfect hashing of 128-bit keys with numpy.

Level by level, the keys left over are hashed to half as many places again. A key
alone at its place is settled there; the others go on to the next level. A key's
slot is the number of settled places before its own, so n keys fill the slots 0 to
n - 1. The key found at a slot tells whether a looked-up key is one of them.
"""

from __future__ import annotations

import numpy as np

ROOM = 1.5
LEVELS = 200


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level puts the keys (rows of two unsigned 64-bit numbers)."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15))
        x = x + np.uint64(level + 1) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots of distinct keys. Equal keys, which no level can part, are an error."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        slots = np.empty(len(keys), np.int64)
        left, settled = np.arange(len(keys)), 0
        while len(left):
            if len(self.levels) == LEVELS:
                raise ValueError("keys are not distinct")
            size = int(ROOM * len(left)) + 1
            places = _places(keys[left], len(self.levels), size)
            alone = np.bincount(places, minlength=size) == 1
            # slot of a settled place, -1 elsewhere
            ranks = np.where(alone, settled + np.cumsum(alone) - 1, -1)
            self.levels.append(ranks)
            found = ranks[places]
            slots[left[found >= 0]] = found[found >= 0]
            left, settled = left[found < 0], settled + int(alone.sum())
        self.slots = slots
        self.stored = np.empty_like(keys)
        self.stored[slots] = keys

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for what is none of the keys."""
        slots, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, ranks in enumerate(self.levels):
            found = ranks[_places(keys[left], level, len(ranks))]
            slots[left[found >= 0]] = found[found >= 0]
            left = left[found < 0]
        own = slots >= 0
        own[own] = (self.stored[slots[own]] == keys[own]).all(axis=1)
        return np.where(own, slots, -1)
