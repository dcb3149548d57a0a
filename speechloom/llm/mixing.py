"""Mixing sources to target weights with a low-discrepancy schedule.

1. ``targets``: the words each source shall give. Sources share the words of all
   documents by weight; a source gives at most ``most`` times what it has, and
   what it cannot give is shared by the others.
2. ``schedule``: numbered slots of ``block`` words. Slot ``i`` goes to the source
   in whose part of the cumulative targets the van der Corput point of ``i``
   (its bits mirrored behind the point) falls. Any run of slots holds every
   source close to its share. Slots are ranked within their source.
3. ``laid_out``: the documents of a source, shuffled by a hash and laid end to
   end, are cut into blocks of equal words.
4. A source's slot of rank ``r`` takes its block ``r``, starting over when the
   source is used up, at most ``most`` times.

Ranks and positions are prefix sums in two steps, over ranges and within a
range, so that no source is ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechloom.llm.columns import cut

WEIGHTS = (5, 2, 1)
BLOCK = 32
MOST = 3
# Bits of a van der Corput point, and slots that one window orders.
BITS = 48
SLOT_RANGE = 1 << 14
# Cells of points that a slot is looked up by, as a power of two.
CELL_BITS = 12
# Hexadecimal digits of a shuffle code that name a range of it.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null has none."""
    found = F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(found, F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source (``_mx_source``, ``source_size``): its place ``number`` by code
    point with null last, ``weight`` and ``target``.

    Sources that reach their limit first, by limit over weight, are set to it;
    the others share the rest in proportion to their weights.
    """
    everything = W.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("_mx_source").isNull(), F.col("_mx_source").cast("binary"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("number") % len(weights) + 1).cast("int"),
    )
    rows = (
        sizes.withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("most", (most * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    # All before and with a source in the order in which limits are reached.
    so_far = everything.orderBy("ratio", "number").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("most").over(so_far), F.lit(0.0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0))
    # The level if all before this source are at their limit and none after.
    level = (total - before) / open_
    fits = level <= F.col("ratio")
    found = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True)
    first = found.over(everything.orderBy("ratio", "number").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least("most", F.coalesce("first", "ratio") * F.col("weight"))
    return (
        rows.withColumn("level", level)
        .withColumn("fits", fits)
        .withColumn("first", first)
        .withColumn("target", F.round(target, 6))
        .select("_mx_source", "source_size", "number", "weight", "target")
    )


def van_der_corput(number: Column) -> Column:
    """The number's bits mirrored, as a whole number below 2 to the ``BITS``."""
    bits = F.reverse(F.lpad(F.bin(number), BITS, "0"))
    return F.conv(bits, 2, 10).cast("long")


def schedule(parts: DataFrame, slots: int) -> DataFrame:
    """``slot``, source ``number`` and ``rank`` (from 0, within the source) of each
    of ``slots`` slots. ``parts`` has the points (whole numbers from ``low`` to
    below ``high``) that each source owns."""
    # A source is listed in every cell of points it reaches into, so that slots
    # find theirs by their cell.
    cell = 1 << (BITS - CELL_BITS)
    cells = parts.where("low < high").select(
        "number",
        "low",
        "high",
        F.explode(
            F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))
        ).alias("cell"),
    )
    points = parts.sparkSession.range(slots).select(
        F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("point")
    )
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    rows = (
        points.join(cells, "cell")
        .where("low <= point and point < high")
        .select("slot", "number", F.floor(F.col("slot") / SLOT_RANGE).alias("range"))
    )
    counted = rows.groupBy("number", "range").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("number").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.select(
        "number", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")
    )
    inside = W.partitionBy("number", "range").orderBy("slot")
    ranked = rows.withColumn("at", F.row_number().over(inside) - 1)
    return ranked.join(counted, ["number", "range"]).select(
        "slot", "number", (F.col("base") + F.col("at")).alias("rank")
    )


def laid_out(rows: DataFrame) -> DataFrame:
    """Adds ``start``: where a document begins among the words of its source
    (``number``) when this is shuffled by ``code`` and laid end to end."""
    rows = rows.withColumn("range", F.substring("code", 1, RANGE_DIGITS))
    sums = rows.groupBy("number", "range").agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("number").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        "number", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")
    )
    inside = (
        W.partitionBy("number", "range").orderBy("code").rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, ["number", "range"])
        .withColumn("start", F.col("base") + F.col("at"))
        .drop("range", "base", "at")
    )


def _planned(docs, weights, block, most, seed, id_column, text_column, source_column):
    """Documents with their source's plan and their place in it, and how often
    (``slot`` by ``slot``) each block of each source is taken."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    name = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            F.col(f"`{id_column}`").alias("id"),
            F.col(f"`{source_column}`").cast("string").alias("source"),
            word_count(text).alias("size"),
            F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.md5(text))).alias("code"),
        )
    )
    plan = targets(
        rows.groupBy(F.col("source").alias("_mx_source")).agg(F.sum("size").alias("source_size")),
        weights,
        most,
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    # Exact sums, so that every run sees the same bounds.
    reach = F.sum(F.col("target").cast("decimal(30,6)"))
    up_to = W.partitionBy(F.lit(1)).orderBy("number")
    point = lambda x: F.least(
        F.floor(x.cast("double") / F.lit(float(max(total, 1))) * F.lit(float(1 << BITS))), F.lit(1 << BITS)
    )
    last = F.col("number") == F.max("number").over(W.partitionBy(F.lit(1)))
    plan = plan.withColumn(
        "low", point(F.coalesce(reach.over(up_to.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ).withColumn("high", F.when(last, F.lit(1 << BITS)).otherwise(point(reach.over(up_to))))
    plan = cut(plan)
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["_mx_source"])).select(
        *rows.columns, "number", "source_size", "target"
    )
    blocks = F.ceil(F.col("source_size") / block)
    uses = (
        schedule(plan, -(-total // block))
        .join(plan.select("number", blocks.alias("blocks")), "number")
        .where(F.col("rank") < most * F.col("blocks"))
        .select("slot", "number", (F.col("rank") % F.col("blocks")).alias("block"))
    )
    return laid_out(placed), uses


def _cut_in_blocks(placed: DataFrame, block: int) -> DataFrame:
    """A row per block that a document reaches into, with the words in it."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    rows = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.withColumn("first_word", begin - F.col("start")).withColumn("words", end - begin)


def pieces(
    docs: DataFrame,
    weights=WEIGHTS,
    block: int = BLOCK,
    most: int = MOST,
    seed: int = 42,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The mix itself: ``slot``, the document's id, ``first_word`` (from 0) and
    ``words``, a row for each stretch of a document that a slot takes. In the
    order of slots, the words of any stretch of the mix are near the weights.
    Nulls and repeats are as in ``mixed``."""
    placed, uses = _planned(docs, weights, block, most, seed, id_column, text_column, source_column)
    return (
        _cut_in_blocks(placed, block)
        .join(uses, ["number", "block"])
        .select("slot", F.col("id").alias(id_column), "first_word", "words")
    )


def mixed(
    docs: DataFrame,
    weights=WEIGHTS,
    block: int = BLOCK,
    most: int = MOST,
    seed: int = 42,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """A row per document: its id, ``source``, ``size`` (words), ``source_size``
    (of all documents of the source), ``target`` (words the source shall give)
    and ``taken`` (words of the document that the schedule takes, repeats
    counted).

    A null source is one source, the last. A null, empty or blank text has size
    0 and gives nothing. Ids may be null or repeat; such rows are shuffled by
    their texts, and among rows equal in id and text it does not matter which is
    taken how often. Other columns play no part. An empty table gives an empty
    table.
    """
    placed, uses = _planned(docs, weights, block, most, seed, id_column, text_column, source_column)
    times = uses.groupBy("number", "block").agg(F.count("*").alias("times"))
    own = ["id", "source", "size", "source_size", "target"]
    given = (
        _cut_in_blocks(placed, block)
        .join(times, ["number", "block"], "left")
        .groupBy("number", "start", *own)
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        .select(*own, "taken")
    )
    none = placed.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return given.union(none).withColumnsRenamed({"id": id_column, "source": source_column})
