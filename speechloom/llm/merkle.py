"""A Merkle manifest of a dataset: what every row's proof of membership is made of.

1. ``leaves``: a row's digest over its fields.
2. ``ranked``: rows of a source are numbered in the order of their ids. Rows are
   dealt by range, and numbers are sums of two steps, so that a source of any size
   is spread over many tasks.
3. ``families``: nodes are labelled with the interval of leaf ranks they cover. Up
   to 16 neighbours make a family, whose digest is the next level's node. A family
   is the largest group there is.
4. ``attached``: each family finds its parent by a join on the bucket its interval
   falls into at the parent's level, checked by containment. The parent's interval
   less the family's own are the siblings, left and right of it. The siblings of a
   family and of all its ancestors are handed down with it, once per family instead
   of once per row.
5. ``proofs``: a leaf, folded with its siblings level by level, gives the root.

Sources are trees of their own, and their roots are leaves of one more tree.
Digests are 32 bytes; where they are hashed they are lowercase hexadecimal text.

A null field is ``-``. Rows without id come last; rows with the same id stand in the
order of their digests, and of equal rows it does not matter which is which. A null
source is a source, the first. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechloom.llm.columns import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
SIBLINGS = "array<struct<left: binary, right: binary>>"


def hashed(digests: Column) -> Column:
    """Digest of digests that are put together as one binary."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)).cast("binary"), 256))


def joined(kids: Column) -> Column:
    """The digests of an array of nodes, one after another."""
    return F.unhex(F.array_join(F.transform(kids, lambda k: F.hex(k["digest"])), ""))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row's fields, each as its length in bytes, a colon and its text."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]).cast("binary"), 256))


def leaves(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    order: str = "doc_id",
    group: str = "source",
    claims: dict[str, Column] | None = None,
) -> DataFrame:
    """``source``, ``id``, ``digest`` and ``claim`` of every row. A claim is the
    digest of a row that says of itself to be this one; ``claims`` has the
    expressions for fields it gives otherwise. Equal digests are held once."""
    digest = leaf([F.col(f"`{c}`") for c in fields])
    claim = leaf([(claims or {}).get(c, F.col(f"`{c}`")) for c in fields])
    return docs.select(
        F.col(f"`{group}`").cast("string").alias("source"),
        F.col(f"`{order}`").alias("id"),
        digest.alias("digest"),
        claim.alias("claim"),
    ).withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim")))


def ranked(rows: DataFrame) -> DataFrame:
    """Rows (``source``, ``id``, ``digest`` and others) with the number ``tree`` of
    their source, in whose order sources stand, its ``size`` and the rank ``lo``
    within it, from 0."""
    order = [F.asc_nulls_first("source"), F.asc_nulls_last("id"), F.asc("digest")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    # A row for each source in each part of the table: few to a source, and a part's
    # rows are few to each of them.
    held = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("source")
    held = held.select(
        F.col("source").alias("_source"),
        F.col("part").alias("_part"),
        "first",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"),
        F.sum("n").over(whole).alias("size"),
        F.min("first").over(whole).alias("tree"),
    )
    same = (placed["part"] == held["_part"]) & placed["source"].eqNullSafe(held["_source"])
    return (
        placed.join(held, same)
        .withColumn("lo", F.col("base") + F.col("place") - F.col("first"))
        .drop("_source", "_part", "first", "base", "place", "part", "source")
    )


def families(rows: DataFrame, payload: Sequence[str] = ()) -> list[DataFrame]:
    """Of ``ranked`` rows, for every level from the leaves on, the families:
    ``tree``, ``size`` (its leaves), ``lo`` and ``hi`` (the leaf ranks covered, hi
    excluded), ``kids`` (the same of each, with its digest, in order; of leaves also
    the ``payload``) and ``digest``. A tree of one leaf has a family whose digest is
    that leaf."""
    rows = rows.withColumn("hi", F.col("lo") + 1)
    levels: list[DataFrame] = []
    while True:
        reach = FAN ** (len(levels) + 1)
        kid = F.struct("lo", "hi", "digest", *(payload if not levels else ()))
        kids = F.sort_array(F.collect_list(kid))
        family = rows.groupBy("tree", "size", F.floor(F.col("lo") / reach).alias("bucket")).agg(kids.alias("kids"))
        alone = F.col("size") == 1
        family = family.select(
            "tree",
            "size",
            F.col("kids")[0]["lo"].alias("lo"),
            F.element_at("kids", -1)["hi"].alias("hi"),
            "kids",
            F.when(alone, F.col("kids")[0]["digest"]).otherwise(hashed(joined(F.col("kids")))).alias("digest"),
        )
        levels.append(cut(family))
        if not levels[-1].where(F.col("size") > reach).take(1):
            return levels
        rows = levels[-1].where(F.col("size") > reach).drop("kids")


def nodes(levels: Sequence[DataFrame]) -> DataFrame:
    """Every node above the leaves: ``tree``, ``level``, interval and digest."""
    tables = [t.select("tree", F.lit(k + 1).alias("level"), "lo", "hi", "digest") for k, t in enumerate(levels)]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def is_top(level: int) -> Column:
    """Whether a family of this level (from 0) is the whole of its tree."""
    return F.col("size") <= FAN ** (level + 1)


def _siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """The parent's interval less one's own: the digests left and right of it."""
    return F.struct(
        joined(F.filter(kids, lambda k: k["hi"] <= lo)).alias("left"),
        joined(F.filter(kids, lambda k: k["lo"] >= hi)).alias("right"),
    )


def attached(levels: Sequence[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """Families of the lowest level with ``path``, the siblings of all ancestors from
    the next level up, and the ``subroot`` and ``root`` they lead to. ``above`` has
    these of each tree's own top (``tree``, ``path``, ``subroot``, ``root``);
    without it the trees end there."""
    found = None
    for level in reversed(range(len(levels))):
        own = levels[level]
        tops = own.where(is_top(level))
        if above is None:
            tops = tops.select("*", F.array().cast(SIBLINGS).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
        else:
            tops = tops.join(above, "tree")
        if found is not None:
            reach = FAN ** (level + 2)
            parents = found.select(
                "tree",
                F.floor(F.col("lo") / reach).alias("bucket"),
                F.col("lo").alias("from"),
                F.col("hi").alias("to"),
                F.col("kids").alias("peers"),
                "path",
                "subroot",
                "root",
            )
            inner = own.where(~is_top(level)).withColumn("bucket", F.floor(F.col("lo") / reach))
            inside = (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
            step = _siblings(F.col("peers"), F.col("lo"), F.col("hi"))
            inner = (
                inner.join(parents, ["tree", "bucket"])
                .where(inside)
                .withColumn("path", F.concat(F.array(step), "path"))
                .drop("bucket", "from", "to", "peers")
            )
            tops = inner.unionByName(tops)
        found = tops
    return found


def with_paths(families_: DataFrame) -> DataFrame:
    """A row per leaf of ``attached`` families: what its family holds of it, and its
    whole ``path``. The only leaf of a tree has no siblings there."""
    rows = families_.select("tree", "size", "kids", "path", "subroot", "root", F.explode("kids").alias("kid"))
    step = _siblings(F.col("kids"), F.col("kid")["lo"], F.col("kid")["hi"])
    path = F.when(F.col("size") == 1, F.col("path")).otherwise(F.concat(F.array(step), "path"))
    return rows.select("tree", "kid.*", path.alias("path"), "subroot", "root")


def manifest(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The families of all sources' trees, and of the tree over their subroots."""
    below = families(ranked(rows), ["id", "claim"])
    tops = None
    for level, table in enumerate(below):
        found = table.where(is_top(level)).select(F.lit("").alias("source"), F.col("tree").alias("id"), "digest")
        tops = found if tops is None else tops.unionByName(found)
    return below, families(ranked(tops), ["id"])


def proofs(below: Sequence[DataFrame], top: Sequence[DataFrame]) -> DataFrame:
    """Per leaf: ``id``, ``digest``, ``claim``, ``path`` (siblings left and right,
    level by level up to the root), ``subroot`` and ``root``."""
    subroots = with_paths(attached(top)).select(
        F.col("id").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
    )
    return with_paths(attached(below, subroots)).select("id", "digest", "claim", "path", "subroot", "root")


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, digest, lambda node, step: hashed(F.concat(step["left"], node, step["right"])))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, in order."""
    sides = F.transform(path, lambda step: F.hex(F.concat(step["left"], step["right"])))
    return F.unhex(F.sha2(F.lower(F.array_join(sides, "")).cast("binary"), 256))


def verified(docs: DataFrame, fields=FIELDS, order="doc_id", group="source", claims=None) -> DataFrame:
    """A row per row of ``docs``: its id, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root`` (from the claim, or the leaf if there is no other)
    and whether this is the root. Digests are lowercase hexadecimal text."""
    rows = proofs(*manifest(cut(leaves(docs, fields, order, group, claims))))
    text = lambda c: F.lower(F.hex(c))
    rows = rows.withColumn("folded_root", folded(F.coalesce("claim", "digest"), F.col("path")))
    return rows.select(
        F.col("id").alias(order),
        text("digest").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        text(path_digest(F.col("path"))).alias("proof_sha256"),
        text("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_text(order: str = "doc_id", text: str = "text", every: int = 5) -> Column:
    """Lower-cased (A-Z) in rows whose id hashes to a multiple of ``every``, not in
    those without id."""
    chosen = F.crc32(F.col(f"`{order}`").cast("string").cast("binary")) % every == 0
    changed = F.translate(F.col(f"`{text}`").cast("string"), UPPER, LOWER)
    return F.when(chosen, changed).otherwise(F.col(f"`{text}`"))
