"""Turning array expressions into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_array(df: DataFrame, keep: Sequence[str], array: Column, name: str) -> DataFrame:
    """One row per element that is not NULL, with the ``keep`` columns.

    The array is computed in a projection of its own, so that the explode of a
    plain column compiles into one loop with what follows. It is an outer
    explode because for an inner one Spark first tests that the array is not
    empty, and by pushing that test down computes the array twice.
    """
    return (
        df.select(*keep, array.alias(name))
        .select(*keep, F.explode_outer(name).alias(name))
        .where(F.col(name).isNotNull())
    )


def explode_runs(df: DataFrame, keep: Sequence[str], array: str, names: Sequence[str]) -> DataFrame:
    """One row per run of as many neighbours as there are names, in a column each, with
    the ``keep`` columns. The array is a column and has no NULLs. Each element comes with
    its place, at which its neighbours are looked up: no array of runs is made."""
    if len(names) == 1:
        return explode_array(df, keep, F.col(array), names[0])
    first, *others = names
    return (
        df.select(*keep, array, F.posexplode_outer(array).alias("_place", first))
        .select(*keep, first, *[F.get(array, F.col("_place") + k).alias(n) for k, n in enumerate(others, 1)])
        .where(F.col(names[-1]).isNotNull())
    )
