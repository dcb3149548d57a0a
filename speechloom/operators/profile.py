"""Structure report of a set of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.plans.literals import literal_table


def table_profile(tables: dict[str, DataFrame], distinct: bool = False) -> DataFrame:
    """Per table and column: position, type, rows, NULLs and, on request, an
    estimate of the distinct values. One aggregation per table, no shuffle of rows."""

    def profile(name: str, df: DataFrame) -> DataFrame:
        measures = [F.count("*").alias("n_rows")]
        for i, c in enumerate(df.columns):
            measures.append(F.count(F.col(c)).alias(f"_set{i}"))
            if distinct:
                measures.append(F.approx_count_distinct(c).alias(f"_distinct{i}"))
        columns = [
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(c).alias("column_name"),
                F.lit(t).alias("column_type"),
                (F.col("n_rows") - F.col(f"_set{i}")).alias("n_nulls"),
                *([F.col(f"_distinct{i}").alias("n_distinct")] if distinct else []),
            )
            for i, (c, t) in enumerate(df.dtypes)
        ]
        return (
            df.agg(*measures)
            .select("n_rows", F.explode(F.array(*columns)).alias("column"))
            .select(F.lit(name).alias("table_name"), "n_rows", "column.*")
        )

    return reduce(DataFrame.unionByName, [profile(n, df) for n, df in tables.items()])


def distinct_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column the number of distinct values, NULLs aside.

    A table is read once. A value is known by 128 bits of hashes from the scan on, so
    that no text moves; each task sends a column's value once."""

    def values(number: int, df: DataFrame) -> DataFrame:
        def named(i: int, c: str) -> Column:
            value = F.col(f"`{c}`")
            code = F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))
            return F.struct(F.lit(number).alias("table"), F.lit(i).alias("column"), F.when(value.isNotNull(), code).alias("code"))

        return df.select(F.inline(F.array(*[named(i, c) for i, c in enumerate(df.columns)])))

    spark = next(iter(tables.values())).sparkSession
    names = [(n, i, t, c) for n, (t, df) in enumerate(tables.items()) for i, c in enumerate(df.columns)]
    names = literal_table(spark, names, ["table", "column", "table_name", "column_name"])
    found = reduce(DataFrame.unionByName, [values(n, df) for n, df in enumerate(tables.values())])
    counts = (
        found.where(F.col("code").isNotNull())
        .groupBy("table", "column", "code")
        .agg(F.lit(1).alias("once"))
        .groupBy("table", "column")
        .agg(F.count("*").alias("n"))
    )
    return names.join(counts, ["table", "column"], "left").select(
        "table_name", "column_name", F.coalesce("n", F.lit(0).cast("long")).alias("n_distinct")
    )
