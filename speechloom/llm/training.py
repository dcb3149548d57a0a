"""Labelled rows to learn from, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_column: Column, parts: int) -> Column:
    """CRC-32 of an id's text, modulo ``parts``; a null id counts as empty text."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts


# Of rows to draw a few from, so many times more are first picked by hash.
SPARE = 8
PARTS = 1 << 30


def few_by_hash(df: DataFrame, keys: list[str], wanted: int, total: int) -> DataFrame:
    """At most ``wanted`` of ``total`` rows, those with the least hashes of their
    keys. What is sorted is a bounded multiple of them, whatever the total."""
    code = F.xxhash64(*keys)
    if total > SPARE * wanted:
        df = df.where(F.pmod(code, F.lit(PARTS)) < SPARE * wanted * PARTS // total)
    return df.orderBy(F.pmod(code, F.lit(PARTS)), *keys).limit(wanted)


def _known(labels: DataFrame, label: str, learn: Column, id_column: str) -> DataFrame:
    known = labels.select(
        F.col(f"`{id_column}`").alias("_tr_id"), F.col(f"`{label}`").cast("int").alias("_tr_label")
    ).where(F.col("_tr_id").isNotNull() & F.col("_tr_label").isin(0, 1))
    return known.withColumnRenamed("_tr_id", id_column).where(learn)


def labelled_ids(labels: DataFrame, label: str, learn: Column, id_column: str) -> tuple[DataFrame, float]:
    """All labels that may be learnt from (``id_column``, ``_tr_label``), equal ones
    once, and the share of label 1 among them, repeated ones counted. ``learn`` says
    which may. Labels other than 0 and 1 are passed over."""
    known = _known(labels, label, learn, id_column)
    share = known.agg(F.avg("_tr_label")).first()[0]
    return known.distinct(), 0.5 if share is None else share


def labelled_sample(
    rows: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    per_class: int,
    id_column: str,
) -> tuple[DataFrame, float]:
    """At most ``per_class`` rows of either label (by hash of their id, so that
    reruns agree), with ``id_column`` and ``label``, and the share of label 1
    among all labelled ids that may be learnt from. ``learn`` says which may.
    Labels other than 0 and 1 are passed over."""
    known = _known(labels, label, learn, id_column)
    counted = known.agg(F.count("*"), F.sum("_tr_label")).first()
    ones = counted[1] or 0
    share = ones / counted[0] if counted[0] else 0.5
    chosen = [
        few_by_hash(known.where(F.col("_tr_label") == value), [id_column], per_class, number)
        for value, number in ((0, counted[0] - ones), (1, ones))
    ]
    # At most two times per_class ids.
    ids = F.broadcast(chosen[0].union(chosen[1]).distinct())
    found = rows.where(F.col(f"`{id_column}`").isNotNull()).join(ids, id_column)
    # An id may be that of many rows.
    return found.orderBy(F.xxhash64(id_column), id_column, "_tr_label").limit(2 * per_class), share
