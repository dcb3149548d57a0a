"""Near-duplicate documents by SimHash and multi-index hashing.

1. ``fingerprints``: 64 bits from the XXH64 hashes of a text's word shingles.
2. Copies collapse: every later step sees each distinct fingerprint once.
3. ``linked``: a fingerprint is cut into segments so short that two which differ
   in at most ``max_bits`` differ in at most one bit of some segment. Each
   fingerprint is filed under its own segments, and looks into the files of all
   segments at most one bit away (a Hamming ball). Files around a value that very
   many fingerprints have are cut further, by the bits outside the segment. What
   meets in a file is verified over all 64 bits.
4. ``components``: links are contracted to stars until every fingerprint points
   to the least one it can reach.

In a file the links form a search tree, never all pairs: a fingerprint that has
been reached is not compared again, so that a dense cluster costs little more
than its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.columns import batch_of, cut, portions, schema_of, utf8, without

ADDED = ("fingerprint", "component_id")
SEED = 42
# Rows of a group of files that one task looks through at a time, and rows that
# one task files.
FILE_ROWS = 200_000
FILED_ROWS = 1_000_000
# Fingerprints with one value of a segment from which on the files around it are
# cut further, and files around such values that are sent to all tasks.
HEAVY = 1_000
SENT_FILES = 100_000
# Shingles whose bits are counted at once.
PORTION = 1 << 14


def text_fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PORTION):
        octets = hashes[at : at + PORTION].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int(bits.view(">i8")[0])


def with_fingerprint(
    docs: DataFrame,
    shingle: int = 3,
    text_column: str = "text",
    name: str = "_sh_print",
    keep_text: bool = True,
) -> DataFrame:
    """The documents with their fingerprint as a number, and their text if it is
    to be kept."""
    text = utf8(text_column)
    docs = without(docs, [name, "_sh_text"]).withColumn("_sh_text", text)
    docs = docs if keep_text else without(docs, [text_column])
    columns = [c for c in docs.columns if c != "_sh_text"]

    def run(batches):
        for batch in portions(batches):
            prints = [text_fingerprint(x, shingle) for x in batch.column("_sh_text").to_pylist()]
            table = pa.Table.from_batches([batch]).select(columns)
            yield from batch_of(table, {name: pa.array(prints, pa.int64())}).to_batches()

    return docs.mapInArrow(run, schema_of(docs.select(columns), f"{name} long"))


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of segments, of which one differs in at most one bit."""
    count = max(1, (max_bits + 2) // 2)
    bounds = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _part(value: Column, low: int, width: int) -> Column:
    """Some bits of a number."""
    part = F.shiftrightunsigned(value, low)
    return part.bitwiseAND(F.lit((1 << width) - 1)) if low + width < 64 else part


def _ball(part: Column, width: int) -> list[tuple[Column, bool]]:
    """All values at most one bit from a segment's, and whether it is its own."""
    flips = [0, *[1 << bit for bit in range(width)]]
    flips = [x - (1 << 64) if x >= 1 << 63 else x for x in flips]
    return [(part.bitwiseXOR(F.lit(x).cast("long")), x == 0) for x in flips]


def _filed(segment: int, file: Column, own: bool) -> Column:
    return F.struct(F.lit(segment).alias("segment"), file.alias("file"), F.lit(own).alias("own"))


def _files(value: Column, max_bits: int) -> Column:
    """(segment number, segment value, whether it is the own one) of the Hamming
    ball around each segment of a fingerprint."""
    return F.array(
        *[
            _filed(number, file, own)
            for number, (low, width) in enumerate(_segments(max_bits))
            for file, own in _ball(_part(value, low, width), width)
        ]
    )


def _drawers(max_bits: int) -> Column:
    """The files into which a row of a file with too many is put: the bits outside
    the segment are cut into segments again, of which one differs in at most one
    bit. Rows under their own segment look one bit around, the others lie under
    their own value only: of two that must meet, one is of the former kind. Keys
    are hashes; rows that meet by a collision are told apart by all their bits."""
    segments = _segments(max_bits)
    chosen = F.lit(None)
    for number, (low, width) in enumerate(segments):
        rest = F.shiftleft(F.shiftrightunsigned("print", low + width), low) if low + width < 64 else F.lit(0)
        rest = rest.bitwiseOR(_part(F.col("print"), 0, low)) if low else rest
        bounds = [(64 - width) * k // len(segments) for k in range(len(segments) + 1)]
        around, alone = [], []
        for part, (start, end) in enumerate(zip(bounds, bounds[1:])):
            for value, own in _ball(_part(rest, start, end - start), end - start):
                file = F.xxhash64("segment", "file", F.lit(part), value)
                around.append(_filed(len(segments) + part, file, own))
                alone += around[-1:] if own else []
        drawers = F.when(F.col("own"), F.array(*around)).otherwise(F.array(*alone))
        chosen = F.when(F.col("segment") == number, drawers).otherwise(chosen)
    return chosen


def _tree(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a search tree through fingerprints that are close enough."""
    links, rest = [], np.unique(prints)
    while len(rest) > 1:
        ahead, rest = [rest[0]], rest[1:]
        while ahead and len(rest):
            at = ahead.pop()
            near = np.bitwise_count(rest ^ at) <= max_bits
            if near.any():
                reached = rest[near]
                links += [(int(at), int(x)) for x in reached]
                ahead += list(reached)
                rest = rest[~near]
    return links


def _look(max_bits: int):
    def run(table: pa.Table) -> pa.Table:
        segment = table.column("segment").to_numpy()
        file = table.column("file").to_numpy()
        prints = table.column("print").to_numpy().view(np.uint64)
        own = table.column("own").to_numpy()
        order = np.lexsort((file, segment))
        segment, file, prints, own = segment[order], file[order], prints[order], own[order]
        new = np.r_[True, (file[1:] != file[:-1]) | (segment[1:] != segment[:-1])]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(file)]
        used = np.logical_or.reduceat(own, starts) & (ends - starts > 1)
        links = set()
        for start, end in zip(starts[used].tolist(), ends[used].tolist()):
            if end - start == 2:
                a, b = prints[start], prints[start + 1]
                if int(a ^ b).bit_count() <= max_bits:
                    links.add((int(a), int(b)))
            else:
                links.update(_tree(prints[start:end], max_bits))
        found = np.array(sorted(links), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def _heavy(prints: DataFrame, max_bits: int) -> DataFrame:
    """Segment values that more than ``HEAVY`` fingerprints have, with their number
    ``n`` and, a row each, the files ``around`` them. Any other file has at most
    ``HEAVY`` rows for each value of its ball."""
    segments = _segments(max_bits)
    own = [_filed(k, _part(F.col("print"), low, width), True) for k, (low, width) in enumerate(segments)]
    values = prints.select(F.explode(F.array(*own)).alias("at")).groupBy("at.segment", "at.file")
    values = cut(values.agg(F.count("*").alias("n")).where(F.col("n") > HEAVY))
    around = F.lit(None)
    for number, (_, width) in enumerate(segments):
        files = [F.struct("segment", file.alias("file")) for file, _ in _ball(F.col("file"), width)]
        around = F.when(F.col("segment") == number, F.array(*files)).otherwise(around)
    return values.select("n", F.explode(around).alias("around"))


def filed(prints: DataFrame, max_bits: int) -> tuple[DataFrame, int]:
    """Rows (``print``, ``segment``, ``file``, ``own``) of all files that have to be
    looked through, and their number, nearly."""
    per_print = sum(width + 1 for _, width in _segments(max_bits))
    count = prints.count() * per_print
    heavy = _heavy(prints, max_bits)
    files, members = heavy.agg(F.count("*"), F.sum("n")).first()
    # So small a table comes in few parts; what becomes of it is large.
    prints = prints.repartition(1 + count // FILED_ROWS, "print")
    rows = prints.select("print", F.explode(_files(F.col("print"), max_bits)).alias("at")).select(
        "print", "at.*"
    )
    if files:
        hot = heavy.select("around.*").distinct().withColumn("hot", F.lit(True))
        hot = F.broadcast(hot) if files <= SENT_FILES else hot
        rows = rows.join(hot, ["segment", "file"], "left")
        drawers = rows.where("hot").select("print", F.explode(_drawers(max_bits)).alias("at"))
        rows = rows.where("hot IS NULL").drop("hot").unionByName(drawers.select("print", "at.*"))
    return rows, count + 3 * (members or 0)


def linked(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``print``) that
    connect all those at most ``max_bits`` apart; not every such pair is listed,
    but any two are joined by a path of listed ones."""
    if max_bits == 0:
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b")).limit(0)
    rows, count = filed(prints, max_bits)
    groups = 1 + count // FILE_ROWS
    rows = rows.withColumn("group", F.pmod(F.xxhash64("segment", "file"), F.lit(groups)))
    return rows.groupBy("group").applyInArrow(_look(max_bits), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``vertex`` and ``root``, the least vertex it is connected to, for all
    vertices that have a link. Links are contracted in turns: larger neighbours
    are tied to the least neighbour, then smaller ones, until only stars remain.
    """

    def least(pairs: DataFrame) -> DataFrame:
        """Adds the least of a vertex and its neighbours to each of its pairs."""
        best = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(best, "u").withColumn("m", F.least("u", "m"))

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").distinct()

    state = cut(
        tidy(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    )
    mark = _mark(state)
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = least(tidy(large))
        star = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        state = cut(tidy(star))
        after = _mark(state)
        if after == mark:
            break
        mark = after
    roots = state.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.union(state.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    """Identifies a set of pairs."""
    code = F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))
    return tuple(pairs.agg(F.count("*"), F.sum(code), F.sum(F.col("u").cast("decimal(38,0)"))).first())


def classes(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """``_sh_print``, ``component_id`` and ``_sh_root`` (the least fingerprint of
    the component, which no other one has) for each distinct fingerprint, from
    rows (``_sh_id``, ``_sh_print``)."""
    distinct = cut(prints.groupBy("_sh_print").agg(F.min("_sh_id").alias("least")))
    roots = components(linked(distinct.select(F.col("_sh_print").alias("print")), max_bits))
    rooted = distinct.join(roots, distinct["_sh_print"] == roots["vertex"], "left").select(
        "_sh_print", "least", F.coalesce("root", "_sh_print").alias("root")
    )
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(of_root, "root").select(
        "_sh_print", "component_id", F.col("root").alias("_sh_root")
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the least id it is connected to by fingerprints that differ
    in at most ``max_bits`` bits.

    A text of fewer words than ``shingle`` is one shingle. Null, empty and blank
    texts have fingerprint zero and are linked like any other. Rows without id
    get a row too; they count as a component's id only if no row of it has one,
    which then is null. Repeated rows and ids are kept. Other columns play no
    part. An empty table gives an empty table.
    """
    ids = docs.select(F.col(f"`{id_column}`").alias("_sh_id"), F.col(f"`{text_column}`").alias("_sh_body"))
    prints = cut(with_fingerprint(ids, shingle, "_sh_body", keep_text=False))
    return prints.join(classes(prints, max_bits), "_sh_print").select(
        F.col("_sh_id").alias(id_column),
        F.lower(F.lpad(F.hex("_sh_print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The documents without near-duplicates: of each component only the row
    with the least id stays (of rows that share it, one with the least text).

    Nulls are as in ``near_duplicates``; of a component without any id one row
    stays. All columns are kept as they are.
    """
    key = ["_sh_id", "_sh_hash"]
    text = F.col(f"`{text_column}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_sh_row"),
        F.col(f"`{id_column}`").alias("_sh_id"),
        F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("_sh_hash"),
    )
    known = rows.select(*key, F.col("_sh_row").getField(text_column).alias("_sh_body"))
    prints = cut(with_fingerprint(known, shingle, "_sh_body", keep_text=False))
    joined = prints.join(classes(prints, max_bits), "_sh_print")
    # Ids are ordered with nulls last; the hash settles which row of an id stays.
    # Components without any id, or with the same least one, are not the same.
    kept = joined.groupBy("_sh_root").agg(
        F.min(F.struct(F.col("_sh_id").isNull().alias("none"), *key)).alias("first")
    )
    kept = kept.select("first._sh_id", "first._sh_hash")
    same = [rows[k].eqNullSafe(kept[k]) for k in key]
    return rows.join(kept, same[0] & same[1], "left_semi").dropDuplicates(key).select("_sh_row.*")
