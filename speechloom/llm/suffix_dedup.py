"""Removal of passages that stand in an earlier document, by suffix arrays.

A string of ``length`` bytes is a repeat in a document if it also starts in a
document with a smaller id. To decide this for every byte of a corpus, strings
that could be equal have to meet in one suffix array of bounded size:

1. ``anchors``: every string of ``length`` bytes owns one anchor, the k-gram in
   it with the smallest hash. Equal strings own equal anchors. Documents are
   dealt to batches; a batch sends each anchor's hash once, with the number of
   its documents that hold it.
2. ``places``: a hash found in at least two documents gets a place (a block of
   text to sort). Anchors that stand close to each other in one document, the
   first known one, go to the same place, so that long passages travel in one
   piece. An anchor found in very many documents gets a place of its own, and
   one whose pieces would overfill it gets many: each of its strings goes by
   itself to the place that its own hash names, where equal ones still meet.
3. ``pieces``: the batch cuts the stretches of its texts whose strings own such
   anchors. It sends each distinct piece once, with its occurrences in the
   batch's first document that holds it; those in later ones are repeats.
4. ``repeats``: each place builds one suffix array over its distinct pieces
   (two-stage sorting) and compares neighbours. Strings that share their whole
   length form a group; those in documents after the group's first are repeats.
5. ``marked``: the batch removes the bytes under its repeats.

Hash collisions only bring pieces together needlessly; equality is always
decided by the suffix array. A batch, a place and a bucket of hashes have a
size that does not grow with the corpus; their number does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.columns import batch_of, id_or_last, schema_of, utf8, without
from speechloom.llm.suffix_array import common_prefixes, suffix_array, words_at

ADDED = ("n_bytes", "n_removed", "spans", "kept")
# Bytes of text in a batch, behind a bucket of hashes, and behind a place.
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
PLACE_BYTES = 1 << 20
# Anchors within so many bytes of a document share a place, unless more
# documents than this hold them.
STRETCH = 1 << 10
COMMON = 64
# Texts are hashed in portions that stay in the processor's cache.
PORTION = 1 << 17
SEPARATOR = b"\xff"
MULTIPLIER = 0x9E3779B97F4A7C15
MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(values: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), MIXERS):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position, put together from halves."""
    total, done = None, 0
    power, width = np.take(BYTES, data), 1
    while True:
        if size & width:
            if total is None:
                total = power
            else:
                shift = np.uint64(pow(MULTIPLIER, width, 1 << 64))
                n = len(data) - done - width + 1
                total = total[done * 0 : n] * shift + power[done : done + n]
            done += width
        if done == size:
            return _mix(total)
        shift = np.uint64(pow(MULTIPLIER, width, 1 << 64))
        power = power[:-width] * shift + power[width:]
        width *= 2


def _sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    width = 1
    while 2 * width <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = window - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _gram(length: int) -> int:
    """Bytes of a string that its anchor has."""
    return max(1, min(20, length - 1))


def _anchors(texts: list[bytes], length: int):
    """For a run of strings that own the same anchor: (document, first start in
    it, one past the last start, anchor hash, anchor position in the batch)."""
    gram = _gram(length)
    parts, base, first = [], 0, 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size == 0 or size + len(texts[last]) <= PORTION):
            size += len(texts[last])
            last += 1
        data = np.frombuffer(b"".join(texts[first:last]), np.uint8)
        sizes = np.fromiter(map(len, texts[first:last]), np.int64, last - first)
        offsets = np.cumsum(sizes) - sizes
        if len(data) >= length:
            hashes = _gram_hashes(data, gram)
            ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
            at = (_sliding_min(ranked, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            owner = np.repeat(np.arange(last - first), sizes)[: len(at)]
            whole = np.arange(len(at)) + length <= (offsets + sizes)[owner]
            change = np.ones(len(at), bool)
            change[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
            starts = np.flatnonzero(change & whole)
            ends = np.flatnonzero(whole & np.r_[change[1:] | ~whole[1:], True]) + 1
            who = owner[starts]
            parts.append(
                (
                    who + first,
                    starts - offsets[who],
                    ends - offsets[who],
                    hashes[at[starts]],
                    at[starts] + base,
                )
            )
        base += size
        first = last
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty
    return tuple(np.concatenate(column) for column in zip(*parts))


def _ordered(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A batch's documents in a fixed order: their row numbers, texts and ids."""
    ids = table.column("_sd_id").to_pylist()
    texts = [text or b"" for text in table.column("_sd_text").to_pylist()]
    rows = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return (
        np.array(rows, np.int64),
        [texts[i] for i in rows],
        np.array([ids[i] for i in rows], np.int64),
    )


def _hash_key(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket from a hash's low half, and its high half."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return (low % np.uint64(buckets)).astype(np.int64), high.astype(np.int64)


def _edges(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and one past the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)]


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the values between each two edges."""
    offsets = (edges * values.itemsize).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, buffers)


def _within(sizes: np.ndarray) -> np.ndarray:
    """For runs of these sizes, laid end to end, each element's number in its run."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _send_anchors(length: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        batch = table.column("_sd_batch")[0].as_py()
        _, texts, _ = _ordered(table)
        who, _, _, hashes, at = _anchors(texts, length)
        if not len(who):
            return _table([], ANCHORS)
        bucket, high = _hash_key(hashes, buckets)
        key = (bucket << 32) | high
        # Documents stand in order, and equal keys stay in it.
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        starts = _edges(key)
        new = np.ones(len(key), np.int64)
        new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        holders = np.minimum(np.add.reduceat(new, starts[:-1]), 0xFFFF).astype(np.uint16)
        one = order[starts[:-1]]
        bucket = bucket[one]
        runs = _edges(bucket)
        return pa.table(
            {
                "_sd_bucket": pa.array(bucket[runs[:-1]], pa.int64()),
                "_sd_batch": pa.array(np.full(len(runs) - 1, batch), pa.int64()),
                "hashes": _binary(high[one].astype(np.uint32), runs),
                "positions": _binary(at[one].astype(np.uint32), runs),
                "holders": _binary(holders, runs),
            }
        )

    return run


def _assign_places(places: int, length: int, place_bytes: int):
    # Bytes of the strings that own an anchor in one document, sent one by one, and
    # of the piece that has them all, with its occurrence.
    each = length * (length - _gram(length) + 1)
    whole = 2 * length - _gram(length) + 24

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("_sd_bucket")[0].as_py()
        table = table.sort_by("_sd_batch")
        batches = table.column("_sd_batch").to_numpy()
        hashes = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        at = np.frombuffer(b"".join(table.column("positions").to_pylist()), np.uint32)
        holders = np.frombuffer(b"".join(table.column("holders").to_pylist()), np.uint16)
        hashes, batch = np.concatenate(hashes), np.repeat(batches, sizes)
        order = np.argsort(hashes, kind="stable")
        starts = _edges(hashes[order])
        total = np.add.reduceat(holders[order].astype(np.int64), starts[:-1])
        first = order[starts[:-1]]
        own = np.full(len(first), 1 << 40, np.uint64) + hashes[first]
        near = (batch[first].astype(np.uint64) << np.uint64(32)) | (at[first] // STRETCH)
        place = _mix(np.where(total > COMMON, own + np.uint64(bucket << 41), near)) % np.uint64(places)
        own_many = (total > COMMON) & (total * whole > place_bytes)
        salts = np.where(own_many, 1 + total * each // place_bytes, 1)
        repeated = np.repeat(total > 1, np.diff(starts))
        place = np.repeat(place, np.diff(starts))[repeated]
        salts = np.repeat(salts, np.diff(starts))[repeated]
        order = order[repeated]
        by_batch = np.argsort(batch[order], kind="stable")
        order, place, salts = order[by_batch], place[by_batch], salts[by_batch]
        batch = batch[order]
        runs = _edges(batch)
        return pa.table(
            {
                "_sd_batch": pa.array(batch[runs[:-1]], pa.int64()),
                "_sd_bucket": pa.array(np.full(len(runs) - 1, bucket), pa.int64()),
                "hashes": _binary(hashes[order], runs),
                "places": _binary(place.astype(np.int64), runs),
                "salts": _binary(salts.astype(np.int64), runs),
            }
        )

    return run


def _cut_pieces(length: int, buckets: int, places: int):
    def run(docs: pa.Table, placed: pa.Table) -> pa.Table:
        if not docs.num_rows or not placed.num_rows:
            return _table([], PIECES)
        batch = docs.column("_sd_batch")[0].as_py()
        _, texts, ids = _ordered(docs)
        parts = [np.frombuffer(x, np.uint32).astype(np.int64) for x in placed.column("hashes").to_pylist()]
        bucket_of = placed.column("_sd_bucket").to_numpy().astype(np.int64)
        known = np.concatenate([(b << 32) | part for b, part in zip(bucket_of, parts)])
        own_place, own_salts = (
            np.frombuffer(b"".join(placed.column(name).to_pylist()), np.int64) for name in ("places", "salts")
        )
        order = np.argsort(known)
        known, own_place, own_salts = known[order], own_place[order], own_salts[order]
        who, start, end, hashes, _ = _anchors(texts, length)
        bucket, high = _hash_key(hashes, buckets)
        key = (bucket << 32) | high
        slot = np.minimum(np.searchsorted(known, key), len(known) - 1)
        place = np.where(known[slot] == key, own_place[slot], -1)
        # An anchor of many places is told by its number instead, below -1.
        place = np.where((place >= 0) & (own_salts[slot] > 1), -2 - slot, place)
        change = np.ones(len(who), bool)
        change[1:] = (who[1:] != who[:-1]) | (place[1:] != place[:-1])
        runs = np.r_[np.flatnonzero(change), len(who)]
        heads, tails = runs[:-1], runs[1:] - 1
        wanted = place[heads] != -1
        heads, tails = heads[wanted], tails[wanted]
        if not len(heads):
            return _table([], PIECES)
        place, who, start = place[heads], who[heads], start[heads]
        size = end[tails] - 1 + length - start
        number = np.unique(place, return_inverse=True)[1]
        code = _codes(_cut(texts, who, start, size))
        group, later = _first_only(number * (code.max() + 1) + code, ids[who])
        spans = [np.stack((who, start, start + size), 1)[later]]
        alone = ~later & (place < -1)
        # The strings of an anchor of many places, each with its own.
        one = np.flatnonzero(alone)
        many = size[one] - length + 1
        one, shift = np.repeat(one, many), _within(many)
        who_, start_ = who[one], start[one] + shift
        strings = _strings(texts, who_, start_, length)
        group_, later_ = _first_only(_codes(pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(length), len(strings), [None, pa.py_buffer(strings)]
        )), ids[who_])
        spans.append(np.stack((who_, start_, start_ + length), 1)[later_])
        slot = -2 - place[one]
        own = _own_places(strings, known[slot], own_salts[slot], places)
        # Other anchors' strings differ; the same one may meet its own.
        kept, kept_ = np.flatnonzero(~later & ~alone), np.flatnonzero(~later_)
        place = np.r_[place[kept], own[kept_]]
        group = np.r_[group[kept], len(group) + group_[kept_]]
        who, start = np.r_[who[kept], who_[kept_]], np.r_[start[kept], start_[kept_]]
        size = np.r_[size[kept], np.full(len(kept_), length)]
        order = np.lexsort((group, place))
        place, group, who, start, size = (x[order] for x in (place, group, who, start, size))
        seen = np.stack((ids[who], who, start), 1)
        edges = _edges(group)
        one = edges[:-1]
        runs = _edges(place[one])
        lists = pa.array(runs, pa.int32())
        found = pa.table(
            {
                "_sd_place": pa.array(place[one][runs[:-1]], pa.int64()),
                "_sd_batch": pa.array(np.full(len(runs) - 1, batch), pa.int64()),
                "pieces": pa.ListArray.from_arrays(lists, _cut(texts, who[one], start[one], size[one])),
                "seen": pa.ListArray.from_arrays(lists, _binary(seen.reshape(-1), 3 * edges)),
            }
        )
        spans = np.concatenate(spans).astype(np.int64)
        if len(spans):
            found = pa.concat_tables([found, _table([(-1 - batch, batch, [], [spans.tobytes()])], PIECES)])
        return found

    return run


def _cut(texts: list[bytes], who: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = (start + size).tolist()
    return pa.array([texts[w][s:e] for w, s, e in zip(who.tolist(), start.tolist(), ends)], pa.binary())


def _strings(texts: list[bytes], who: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A row of bytes for each string."""
    if not len(who):
        return np.zeros((0, length), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum(sizes) - sizes
    return np.lib.stride_tricks.sliding_window_view(joined, length)[offsets[who] + start]


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each value, the same for equal ones."""
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def _first_only(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The occurrences' groups, and which are in documents whose id is not the
    smallest of their group: those are repeats."""
    if not len(group):
        return group, np.zeros(0, bool)
    order = np.argsort(group, kind="stable")
    edges = _edges(group[order])
    least = np.empty(len(group), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], edges[:-1]), np.diff(edges))
    numbered = np.empty(len(group), np.int64)
    numbered[order] = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    return numbered, ids > least


def _own_places(strings: np.ndarray, keys: np.ndarray, salts: np.ndarray, places: int) -> np.ndarray:
    """The place of each string of anchors that have many: those of whole strings
    are numbered after the others."""
    padded = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
    padded[:, : strings.shape[1]] = strings
    digest = np.zeros(len(strings), np.uint64)
    for word in padded.view(np.uint64).T:
        digest = _mix(digest * np.uint64(MULTIPLIER) + word)
    mixed = _mix(_mix(keys.astype(np.uint64)) + digest % salts.astype(np.uint64))
    return places + (mixed % np.uint64(places)).astype(np.int64)


def _find_repeats(length: int, places: int):
    def run(table: pa.Table) -> pa.Table:
        place = table.column("_sd_place")[0].as_py()
        if place < 0:
            rows = zip(table.column("_sd_batch").to_pylist(), table.column("seen").to_pylist())
            return _table([(batch, spans) for batch, seen in rows for spans in seen], REPEATS)
        listed = table.column("pieces").combine_chunks()
        batch = np.repeat(table.column("_sd_batch").to_numpy(), listed.value_lengths().to_numpy())
        known = listed.flatten().dictionary_encode()
        seen = table.column("seen").combine_chunks().flatten()
        times = pc.binary_length(seen).to_numpy() // 24
        seen = np.frombuffer(b"".join(seen.to_pylist()), np.int64).reshape(-1, 3)
        piece, batch = np.repeat(known.indices.to_numpy(), times), np.repeat(batch, times)
        pieces = known.dictionary.to_pylist()
        size = pc.binary_length(known.dictionary).to_numpy().astype(np.int64)
        order = np.argsort(piece, kind="stable")
        least = np.minimum.reduceat(seen[order, 0], _edges(piece[order])[:-1])
        later = seen[:, 0] > least[piece]
        spans = [np.stack((batch, seen[:, 1], seen[:, 2], seen[:, 2] + size[piece]), 1)[later]]
        # Whole strings by themselves are equal or have nothing in common.
        if place < places:
            which, starts, ends = _earlier(_smallest_id(pieces, least, length), least, size, length)
            runs = np.searchsorted(which, np.arange(len(pieces) + 1))
            at = np.flatnonzero(~later & (np.diff(runs) > 0)[piece])
            many = np.diff(runs)[piece[at]]
            span = np.repeat(runs[:-1][piece[at]], many) + _within(many)
            at = np.repeat(at, many)
            spans.append(np.stack((batch[at], seen[at, 1], seen[at, 2] + starts[span], seen[at, 2] + ends[span]), 1))
        spans = np.concatenate(spans).astype(np.int64)
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        runs = _edges(spans[:, 0]) if len(spans) else np.zeros(1, np.int64)
        return pa.table(
            {
                "_sd_batch": pa.array(spans[runs[:-1], 0], pa.int64()),
                "found": _binary(spans[:, 1:].reshape(-1), 3 * runs),
            }
        )

    return run


def _earlier(
    smallest: np.ndarray, first_id: np.ndarray, sizes: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by strings that a document before the piece's
    first one holds: (piece, start in it, end), in order."""
    piece = np.repeat(np.arange(len(sizes)), sizes + 1)
    base = np.cumsum(sizes + 1) - sizes - 1
    at = np.flatnonzero(smallest < first_id[piece])
    at = at[at - base[piece[at]] + length <= sizes[piece[at]]]
    piece = piece[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] - at[:-1] > length) | (piece[1:] != piece[:-1])
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(at)] - 1 if len(at) else heads
    which = piece[heads]
    return which, at[heads] - base[which], at[tails] + length - base[which]


def _smallest_id(pieces: list[bytes], first_id: np.ndarray, length: int) -> np.ndarray:
    """For each start of a whole string in the pieces (laid end to end with a
    byte between that no text has), the smallest id that holds this string."""
    block = np.frombuffer(SEPARATOR.join(pieces) + SEPARATOR, np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ids = np.repeat(first_id, sizes + 1)
    if len(pieces) == 1 and sizes[0] < 2 * length:
        return ids
    words = words_at(block, length)
    order = suffix_array(block, length, words)
    shared = common_prefixes(order, words, length)
    groups = np.flatnonzero(shared < length)
    smallest = np.minimum.reduceat(ids[order], groups)
    out = np.empty(len(block), np.int64)
    out[order] = np.repeat(smallest, np.diff(np.r_[groups, len(order)]))
    return out


def _merged(spans: np.ndarray) -> np.ndarray:
    """Unites spans that overlap or touch."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    starts = np.flatnonzero(new)
    return np.stack([spans[starts, 0], reach[np.r_[starts[1:] - 1, len(spans) - 1]]], 1)


def _whole_characters(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    """The spans without the characters of which they hold only some bytes."""
    out = []
    for start, end in spans:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while start < end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append([start, end])
    return out


def _mark(columns: list[str], whole_characters: bool):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        rows, texts, _ = _ordered(docs)
        spans: list[list] = [[] for _ in texts]
        if repeats.num_rows:
            found = np.frombuffer(b"".join(repeats.column("found").to_pylist()), np.int64).reshape(-1, 3)
            # All texts as one, with a byte between that no span has.
            base = np.cumsum([0, *[len(x) + 1 for x in texts]])
            found = _merged(found[:, 1:] + base[found[:, 0], None])
            runs = np.searchsorted(found[:, 0], base)
            for k in np.flatnonzero(np.diff(runs)).tolist():
                spans[k] = (found[runs[k] : runs[k + 1]] - base[k]).tolist()
        if whole_characters:
            spans = [_whole_characters(text, own) for text, own in zip(texts, spans)]
        kept = []
        for text, own in zip(texts, spans):
            ends = [0, *[e for _, e in own]]
            kept.append(b"".join(text[a:b] for a, b in zip(ends, [*[s for s, _ in own], len(text)])))
        docs = docs.take(pa.array(rows))
        size = [len(x) for x in texts]
        listed = [[{"start": s, "end": e} for s, e in own] for own in spans]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        known = docs.column("_sd_text").is_valid().to_pylist()
        added = {
            "n_bytes": pa.array(size, pa.int64()),
            "n_removed": pa.array([n - len(k) for n, k in zip(size, kept)], pa.int64()),
            "spans": pa.array(listed, span),
            "kept": pa.array([k if ok else None for k, ok in zip(kept, known)], pa.binary()),
        }
        return batch_of(docs.select(columns), added)

    return run


ANCHORS = "_sd_bucket long, _sd_batch long, hashes binary, positions binary, holders binary"
PLACED = "_sd_batch long, _sd_bucket long, hashes binary, places binary, salts binary"
PIECES = "_sd_place long, _sd_batch long, pieces array<binary>, seen array<binary>"
REPEATS = "_sd_batch long, found binary"
ARROW = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [field.split() for field in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table(
        {name: pa.array(list(values), ARROW[kind]) for (name, kind), values in zip(fields, columns)}
    )


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    whole_characters: bool = False,
) -> DataFrame:
    """Documents with the spans of bytes that repeat an earlier document.

    In the place of the text come ``n_bytes`` (of the whole text), ``n_removed``,
    ``spans`` (maximal runs ``start``..``end`` of removed bytes) and ``kept``, the
    bytes left. With ``whole_characters`` a character of which only some bytes
    repeat stays, so that ``kept`` is a text again. All other columns are kept,
    but for those that have these names.

    A null text is empty (no bytes, nothing removed); its ``kept`` is null. A
    text shorter than ``length`` is never changed. A row without id comes after
    all others. Rows with the same id never count as earlier than each other.
    Equal rows get equal results. An empty table gives an empty table.
    """
    if length < 2:
        raise ValueError("strings of at least two bytes can be compared")
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_column}`").cast("string")))).first()[0] or 0
    batches, buckets, places = (
        1 + total // size for size in (BATCH_BYTES, BUCKET_BYTES, PLACE_BYTES)
    )
    rest = without(docs, [*ADDED, text_column]).columns
    rows = docs.select(
        *[F.col(f"`{c}`") for c in rest],
        utf8(text_column).alias("_sd_text"),
        id_or_last(id_column).alias("_sd_id"),
    ).withColumn("_sd_batch", F.pmod(F.xxhash64("_sd_id", "_sd_text"), F.lit(batches)))
    by_batch = rows.groupBy("_sd_batch")
    anchors = by_batch.applyInArrow(_send_anchors(length, buckets), ANCHORS)
    placed = anchors.groupBy("_sd_bucket").applyInArrow(
        _assign_places(places, length, PLACE_BYTES), PLACED
    )
    pieces = by_batch.cogroup(placed.groupBy("_sd_batch")).applyInArrow(
        _cut_pieces(length, buckets, places), PIECES
    )
    repeats = pieces.groupBy("_sd_place").applyInArrow(_find_repeats(length, places), REPEATS)
    added = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return by_batch.cogroup(repeats.groupBy("_sd_batch")).applyInArrow(
        _mark(rest, whole_characters), schema_of(docs.select(*[F.col(f"`{c}`") for c in rest]), added)
    )


def digest(marked: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per document that identifies what was removed."""
    return marked.select(
        F.col(id_column),
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"),
    )


def without_repeats(
    docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents with their repeats cut from the texts, whole characters at a
    time; a null text stays null. All columns are kept."""
    # In a structure no column can clash with those the operator adds.
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_column]
    packed = docs.select(
        F.struct(*others).alias("_sd_row"),
        F.col(f"`{id_column}`").alias("_sd_key"),
        F.col(f"`{text_column}`").alias("_sd_body"),
    )
    marked = remove_repeats(packed, length, "_sd_key", "_sd_body", whole_characters=True)
    return marked.select(
        *[
            F.col("kept").cast("string").alias(c)
            if c == text_column
            else F.col("_sd_row").getField(c).alias(c)
            for c in docs.columns
        ]
    )
