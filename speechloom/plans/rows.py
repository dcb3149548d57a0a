"""Rows that have no key of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that one array makes at most.
REPEATS = 1 << 16


def row_digest(*columns: str) -> Column:
    """A name for a row that follows from what is in it, so that a task that runs
    again gives the same one: equal rows share it, others do not."""
    fields = []
    for c in columns:
        text = F.col(c).cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat(*fields))


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says (once at least), without that
    column. No array holds more than ``REPEATS`` entries of one row."""
    last = F.col(times) - 1
    blocks = F.sequence(F.lit(0).cast("long"), F.floor(last / REPEATS))
    within = F.sequence(F.lit(0).cast("long"), F.least(F.lit(REPEATS - 1).cast("long"), last - F.col("_block") * REPEATS))
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumn("_in_block", F.explode(within))
        .drop("_block", "_in_block", times)
    )
