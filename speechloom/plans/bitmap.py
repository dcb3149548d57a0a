"""A filter of fixed size for "is it one of these?", tested where a value is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 512 KB, whatever the number of values. Of a million values, a fifth of the others pass.
BITS = 1 << 22


def _place(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits))


def hash_bits(
    values: DataFrame, column: str, bits: int = BITS, where: Sequence[Column] | None = None
) -> Column | list[Column]:
    """The hashes of a column's values as an array of 64-bit words, for :func:`may_hold`
    with as many ``bits``; with ``where`` one array for the values that meet each of its
    conditions, all from one reading."""
    spark = values.sparkSession
    code = _place(F.col(column), bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (code % 64).cast("int"))
    names = [f"bits{i}" for i in range(len(where or [1]))]
    met = [F.when(c, bit).alias(n) for c, n in zip(where or [F.lit(True)], names)]
    held = values.select(F.floor(code / 64).alias("word"), *met).groupBy("word").agg(*[F.bit_or(n).alias(n) for n in names])
    # Always bits / 64 words.
    dense = spark.range(0, bits // 64, 1, 1).withColumnRenamed("id", "word").join(held, "word", "left")
    word = F.struct("word", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])
    ordered = dense.agg(F.sort_array(F.collect_list(word)).alias("words"))
    # a field of an array of structs is the array of this field
    found = ordered.select(F.struct(*[F.col("words")[n].alias(n) for n in names])).scalar()
    return [found[n] for n in names] if where else found[names[0]]


def may_hold(words: Column, value: Column, bits: int = BITS) -> Column:
    """False for what is none of the values; true for those, and for a few others."""
    code = _place(value, bits)
    word = F.get(words, F.floor(code / 64).cast("int"))
    return F.call_function("shiftright", word, (code % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
