"""Top-k plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first k rows of every group. Spark cuts each task's share of a group
    to k rows before the shuffle, so a group that owns most of the table still
    sends at most k rows per task."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def latest_per_key(df: DataFrame, key: str, newest_by: Sequence[str]) -> DataFrame:
    """One row per key, the one with the largest values in ``newest_by``."""
    order = [F.desc_nulls_last(c) for c in newest_by]
    return top_per_group(df, [key], order, 1, "_rank").drop("_rank")
