"""Documents that hold benchmark items, by greedy string tiling.

A document and an item meet if they share a seed: ``seed`` consecutive tokens.
Seeds are found with a Karp-Rabin hash that runs over the document. For each
such pair the longest common stretch of tokens that are still free on both sides
is marked as a tile, again and again, until none of ``seed`` tokens is left. The
share of the item under tiles is its coverage; because tiles may lie in any
order, an item with its passages rearranged is found as well. Pairs whose tokens
under common seeds are already too few for the coverage are not tiled.

The benchmark is the query set. It is taken in blocks of a bounded number of
bytes, which the driver indexes and sends to all tasks once; documents stay where
they are.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.columns import portions

BLOCK_BYTES = 16 << 20
TOKEN = re.compile(r"\w+")
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Words without punctuation, in lower case."""
    return TOKEN.findall((text or "").lower())


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of the base, and of its inverse."""
    size = 1 << bits
    up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Running:
    """Karp-Rabin hashes of the windows of a sequence: with the sums of codes
    times powers, that of any window, of any width, takes one subtraction."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        up, self.down = _powers(max(self.size, 1).bit_length())
        spread = (codes.astype(np.uint64) + np.uint64(1)) * SPREAD
        spread ^= spread >> np.uint64(32)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(spread * up[: self.size], out=self.sums[1:])

    def windows(self, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows at the given places, or of all."""
        if at is None:
            at = np.arange(max(self.size - width + 1, 0))
        return (self.sums[at + width] - self.sums[at]) * self.down[at]


def _free(used: np.ndarray, width: int) -> np.ndarray:
    """Where windows without a used place begin."""
    if len(used) < width:
        return np.zeros(0, np.int64)
    before = np.r_[0, np.cumsum(used)]
    return np.flatnonzero(before[width:] == before[: len(before) - width])


def _widest(used: np.ndarray) -> int:
    """Length of the longest stretch without a used place."""
    return int(np.diff(np.r_[-1, np.flatnonzero(used), len(used)]).max()) - 1


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values occur in an ordered array that is not empty."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest stretch free on both sides first (then the one
    first in the item, then in the document), down to ``least`` tokens. Gives
    (document start, item start, length) of each tile; negative codes match
    nothing.

    The greatest length at which both sides have a free window of the same hash
    is found by halving, as shorter windows match wherever longer ones do. All
    tiles of that length are laid in one sweep; what is left has only shorter
    ones. No list of matching places is made.
    """
    a_hash, b_hash = Running(doc), Running(item)
    a_used, b_used = doc < 0, item < 0

    def common(size):
        a, b = _free(a_used, size), _free(b_used, size)
        if not len(a) or not len(b):
            return None
        a_codes, b_codes = a_hash.windows(size, a), b_hash.windows(size, b)
        same = _among(a_codes, np.sort(b_codes))
        return (a[same], a_codes[same], b, b_codes) if same.any() else None

    def longest(below):
        high = min(below - 1, _widest(a_used), _widest(b_used))
        if high < least:
            return 0, None
        found = common(high)
        if found:
            return high, found
        low, found = least, common(least)
        if not found:
            return 0, None
        while high - low > 1:
            middle = (low + high) // 2
            better = common(middle)
            low, high, found = (middle, high, better) if better else (low, middle, found)
        return low, found

    tiles = []
    size, found = longest(len(item) + 1)
    while size:
        a, a_codes, b, b_codes = found
        order = np.argsort(a_codes, kind="stable")
        codes, first = np.unique(a_codes[order], return_index=True)
        ends = np.r_[first[1:], len(order)].tolist()
        slots = {code: k for k, code in enumerate(codes.tolist())}
        a, first, end = a[order], first.tolist(), 0
        for start, code in zip(b.tolist(), b_codes.tolist()):
            slot = slots.get(code)
            if slot is None or start < end:
                continue
            for k in range(first[slot], ends[slot]):
                at = int(a[k])
                # Tiles of this sweep are as long as the window: one that meets
                # it covers its first or last token.
                if a_used[at] or a_used[at + size - 1]:
                    first[slot] += k == first[slot]
                # A hash may collide: the tokens decide.
                elif np.array_equal(doc[at : at + size], item[start : start + size]):
                    end = start + size
                    a_used[at : at + size] = b_used[start:end] = True
                    tiles.append((at, start, size))
                    break
        size, found = longest(size)
    return tiles


def _covered(at: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of so many places lie under windows at the given ones."""
    steps = np.zeros(size + 1, np.int64)
    steps[at] += 1
    steps[at + width] -= 1
    return np.cumsum(steps[:size]) > 0


class Items:
    """Benchmark items by their seeds. An item of fewer tokens than a seed is
    one seed of its own length; an item without tokens is never found."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int):
        self.seed = seed
        self.ids = [item for item, _ in rows]
        found = [tokens(text) for _, text in rows]
        self.codes = {t: k for k, t in enumerate(sorted({t for x in found for t in x}))}
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.tokens = np.array([self.codes[t] for x in found for t in x], np.int64)
        owner = np.repeat(np.arange(len(found)), self.sizes)
        width_of, place = np.minimum(self.sizes, seed)[owner], np.arange(len(owner))
        running = Running(self.tokens)
        # By width: hashes in order, where the items of each begin, these items and
        # in how many places of each the hash is found.
        self.seeds = {}
        for width in np.unique(width_of).tolist():
            at = place[(width_of == width) & (place + width <= self.ends[owner])]
            codes = running.windows(width, at)
            order = np.lexsort((owner[at], codes))
            codes, owners = codes[order], owner[at][order]
            new = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1])])
            counts = np.diff(np.r_[new, len(codes)])
            known, bounds = np.unique(codes[new], return_index=True)
            self.seeds[width] = (known, np.r_[bounds, len(new)], owners[new], counts)

    def item(self, number: int) -> np.ndarray:
        return self.tokens[self.ends[number] - self.sizes[number] : self.ends[number]]

    def near(self, codes: np.ndarray, coverage: float):
        """Number, document tokens and item tokens of each item that shares seeds
        with a document, unless the tokens under such seeds are too few for the
        coverage. Tokens under no seed are left out of the document (stretches stay
        apart) and -1 in the item."""
        running = Running(codes)
        for width, (known, bounds, owners, counts) in self.seeds.items():
            at = _free(codes < 0, width)
            found = running.windows(width, at)
            hit = _among(found, known)
            at, found = at[hit], found[hit]
            if not len(at):
                continue
            distinct = np.unique(np.searchsorted(known, found))
            lengths = bounds[distinct + 1] - bounds[distinct]
            pairs = np.repeat(bounds[distinct + 1] - np.cumsum(lengths), lengths) + np.arange(lengths.sum())
            numbers, of = np.unique(owners[pairs], return_inverse=True)
            enough = np.bincount(of, counts[pairs]) * width >= coverage * self.sizes[numbers]
            hashes = np.sort(found)
            for number in numbers[enough].tolist():
                item = self.item(number)
                own = Running(item).windows(width)
                shared = np.flatnonzero(_among(own, hashes))
                under = _covered(shared, width, len(item))
                here = _covered(at[_among(found, np.sort(own))], width, len(codes))
                if min(under.sum(), here.sum()) < coverage * len(item):
                    continue
                # One uncovered place after each stretch keeps it from the next.
                after = np.r_[False, here[:-1]] & ~here
                part = np.where(here, codes, -1)[here | after]
                yield number, part, np.where(under, item, -1)


def overlaps(text: str | None, items: Items, coverage: float = 0.0) -> list[tuple[int, int, int, int]]:
    """(item number, tiles, tokens under tiles, tokens of the item) for each item
    that shares a seed with the text and of which the given share is covered."""
    get = items.codes.get
    codes = np.array([get(t, -1) for t in tokens(text)], np.int64)
    out = []
    for number, part, item in items.near(codes, coverage):
        tiles = tile(part, item, min(items.seed, len(item)))
        matched = sum(size for _, _, size in tiles)
        if tiles and matched >= coverage * len(item):
            out.append((number, len(tiles), matched, len(item)))
    return sorted(out)


def _blocks(benchmark: DataFrame, id_column: str, text_column: str):
    rows = benchmark.select(
        F.col(f"`{id_column}`").cast("long").alias("item"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // BLOCK_BYTES
    for number in range(count):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number)
        yield sorted(
            ((r["item"], r["text"]) for r in block.collect()),
            key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""),
        )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    seed: int = 5,
    coverage: float = 0.8,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """A row per document and benchmark item that is covered at least by the
    given share: the document's id (or the given columns), ``item_id``,
    ``n_tiles``, ``matched_tokens``, ``item_tokens`` and ``coverage``.

    Texts that are null or without a word hold nothing and, as items, are never
    found. An item shorter than a seed must occur whole. Repeated documents and
    items each give rows; ids may be null. Other columns play no part. Empty
    tables give an empty table.
    """
    keep = list(columns) if columns is not None else [id_column]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"`{text_column}`").cast("string").alias("_gt_text"),
    )
    context = docs.sparkSession.sparkContext
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    added = "item_id long, n_tiles long, matched_tokens long, item_tokens long, coverage double"

    def look(sent):
        def run(batches):
            items = sent.value
            for batch in portions(batches):
                at, found = [], []
                for k, text in enumerate(batch.column("_gt_text").to_pylist()):
                    for number, count, matched, size in overlaps(text, items, coverage):
                        at.append(k)
                        found.append((items.ids[number], count, matched, size, matched / size))
                table = pa.Table.from_batches([batch]).select(keep).take(pa.array(at, pa.int64()))
                names = ("item_id", "n_tiles", "matched_tokens", "item_tokens", "coverage")
                for name, values in zip(names, zip(*found) if found else [()] * 5):
                    kind = pa.float64() if name == "coverage" else pa.int64()
                    table = table.append_column(name, pa.array(list(values), kind))
                yield from table.to_batches()

        return run

    parts = [
        rows.mapInArrow(look(context.broadcast(Items(block, seed))), ", ".join([*own, added]))
        for block in _blocks(benchmark, item_id_column, item_text_column)
    ]
    return reduce(DataFrame.union, parts)


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    seed: int = 5,
    coverage: float = 0.8,
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The documents in which no benchmark item is covered by the given share,
    with all their columns. Documents are read where they are, block of items by
    block of items. Nulls and short texts are as in ``leaks``."""
    context = docs.sparkSession.sparkContext

    def clean(sent):
        def run(batches):
            items = sent.value
            for batch in portions(batches):
                free = [
                    not overlaps(text, items, coverage)
                    for text in batch.column(text_column).to_pylist()
                ]
                yield batch.filter(pa.array(free, pa.bool_()))

        return run

    for block in _blocks(benchmark, item_id_column, item_text_column):
        docs = docs.mapInArrow(clean(context.broadcast(Items(block, seed))), docs.schema)
    return docs
