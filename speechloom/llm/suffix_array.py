"""A suffix array of one block of bytes by two-stage sorting, and its common prefixes.

Stage one sorts directly only the suffixes that are smaller than their successor
(the suffix that starts one byte later). Stage two scans the buckets of first
bytes from small to large and induces the place of every other suffix from its
successor. Both work on whole buckets at a time.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def smaller_than_successor(block: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one a byte later. The
    end of the block counts as smaller than any byte, so the last one is not."""
    n = len(block)
    if n == 0:
        return np.zeros(0, bool)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(block[1:].astype(np.int16) - block[:-1])
    step[-1] = -1
    # In a run of equal bytes every suffix is of the type found at its end.
    known = np.where(step != 0, np.arange(n), n)
    ends = np.minimum.accumulate(known[::-1])[::-1]
    return step[ends] > 0


def words_at(block: np.ndarray, depth: int) -> list[np.ndarray]:
    """``depth`` bytes from each position as big-endian words; zeros follow the end."""
    n, count = len(block), -(-depth // WORD)
    padded = np.zeros(n + WORD * count, np.uint64)
    padded[:n] = block
    word = padded
    for width in (1, 2, 4):
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
    return [word[WORD * k : WORD * k + n] for k in range(count)]


def direct_sort(positions: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The positions in the order of the bytes that start there, as deep as the
    words go. Words are compared one after the other, deeper ones only between
    positions that are still tied."""
    first = words[0][positions]
    by_first = np.argsort(first)
    order, first = positions[by_first], first[by_first]
    at, new = np.arange(len(order)), _changes(first)
    for word in words[1:]:
        tied = ~new
        tied[:-1] |= tied[1:]
        at, group = at[tied], np.cumsum(new)[tied]
        if not len(at):
            break
        # Equal codes for equal words, so that (group, word) fits one number.
        value = word[order[at]]
        by_value = np.argsort(value)
        code = np.empty(len(at), np.int64)
        code[by_value] = np.cumsum(_changes(value[by_value]))
        both = (group << 32) | code
        again = np.argsort(both)
        order[at] = order[at[again]]
        new = _changes(both[again])
    return order


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first counts."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def suffix_array(block: np.ndarray, depth: int, words: list[np.ndarray] | None = None) -> np.ndarray:
    """All suffixes of the block, sorted by at least ``depth`` first bytes."""
    n = len(block)
    if n == 0:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(block)
    direct = direct_sort(np.flatnonzero(small), words or words_at(block, depth))
    direct_first = block[direct]
    bounds = np.searchsorted(direct_first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # The empty suffix behind the end is the smallest and induces the last one.
    waiting[block[-1]].append(np.array([n - 1]))
    buckets = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Hands the larger predecessors to their buckets, in order; those that
        start with the same byte are returned."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        first = block[before]
        by_first = np.argsort(first, kind="stable")
        before, first = before[by_first], first[by_first]
        edges = [*np.flatnonzero(_changes(first)).tolist(), len(first)]
        same = before[:0]
        for start, end in zip(edges[:-1], edges[1:]):
            if first[start] == byte:
                same = before[start:end]
            else:
                waiting[first[start]].append(before[start:end])
        return same

    for byte in range(256):
        larger = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waiting[byte] = []
        while len(larger):
            buckets.append(larger)
            larger = induce(larger, byte)
        smaller = direct[bounds[byte] : bounds[byte + 1]]
        if len(smaller):
            buckets.append(smaller)
            induce(smaller, byte)
    return np.concatenate(buckets)


def common_prefixes(order: np.ndarray, words: list[np.ndarray], depth: int) -> np.ndarray:
    """For each suffix in order, how many first bytes it shares with the one
    before it, up to ``depth``."""
    shared = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return shared
    open_ = np.arange(1, len(order))
    for k, word in enumerate(words):
        if 2 * len(open_) > len(order):
            values = word[order]
            different = values[open_] ^ values[open_ - 1]
        else:
            different = word[order[open_]] ^ word[order[open_ - 1]]
        ended = different != 0
        at = open_[ended]
        bits = different[ended]
        zeros = np.zeros(len(bits), np.int64)
        for shift in (32, 16, 8):
            high = bits >> np.uint64(shift)
            none = high == 0
            zeros += np.where(none, shift // 8, 0)
            bits = np.where(none, bits, high)
        shared[at] = WORD * k + zeros
        open_ = open_[~ended]
    shared[open_] = depth
    return np.minimum(shared, depth)
