"""Join plans that hold when one key owns a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hot keys handled apart. The k-th largest of a set of counts is at most 1/k of
# their sum, so a key that is not among these owns under 0.1 % of the rows.
HOT_KEYS = 1024
HOT_SPREAD = 4096
# Rows of a key that one task holds to join them to others.
CELL_ROWS = 1 << 16
# Tasks, at least, that make the results of a join whose cells are small but many.
CELL_TASKS = 128


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size. No job runs for this."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(side: DataFrame) -> bool:
    """Whether Spark's estimate of a side's size is within its own threshold for
    broadcasts. No job runs for this; plans that ask must give the same rows
    either way."""
    settings = side.sparkSession._jsparkSession.sessionState().conf()
    return estimated_bytes(side) <= settings.autoBroadcastJoinThreshold()


def join_counted(
    rows: DataFrame,
    counts: DataFrame,
    keys: Sequence[str],
    weight: str | None = None,
    spread: str | None = None,
    placed: bool = False,
) -> DataFrame:
    """Inner join of ``rows`` to ``counts``, which is unique by ``keys`` and
    says in ``weight`` how many rows each key owns.

    The last key must be a string. The rows of the ``HOT_KEYS`` heaviest keys
    find their match in a broadcast table of exactly those keys. In the shuffle
    that serves the others they carry a stand-in key made from ``spread``: it
    matches nothing and scatters them over the partitions. ``placed`` says that both
    sides lie by ``keys`` already, which then tell the cells of heavy keys apart: no
    row moves, and a task holds its share of ``counts``, the much smaller side, in a
    hash table.
    """
    if placed:
        return rows.join(counts.hint("shuffle_hash"), list(keys))
    *context, key = keys
    payload = F.struct(*[c for c in counts.columns if c not in keys])
    hot = counts.orderBy(F.desc(weight)).limit(HOT_KEYS).select(*keys, payload.alias("_hot"))
    rest = counts.select(*context, F.col(key).alias("_key"), payload.alias("_rest"))
    scattered = F.concat_ws(
        "\u0000", F.col(key), F.pmod(F.xxhash64(spread), F.lit(HOT_SPREAD)).cast("string")
    )
    return (
        rows.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(scattered))
        # the key first: texts are sorted by their first bytes, contexts are often equal
        .join(rest, ["_key", *context], "left")
        .withColumn("_found", F.coalesce("_hot", "_rest"))
        .where(F.col("_found").isNotNull())
        .select(*rows.columns, "_found.*")
    )


def _heavy(df: DataFrame, keys: Sequence[str], cells: str) -> DataFrame:
    """The ``HOT_KEYS`` keys with most rows, and over how many cells each is to be
    spread so that a cell holds no more than about 1/HOT_KEYS of all rows."""
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    share = F.ceil(F.col("_n") * HOT_KEYS / total)
    heavy = counts.orderBy(F.desc("_n"), *keys).limit(HOT_KEYS)
    return heavy.select(*keys, F.least("_n", share).cast("int").alias(cells))


def join_repeated(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: tuple[Sequence[str], Sequence[str]],
    how: str = "left",
) -> DataFrame:
    """Left or full join in which a key may own a large part of the rows on both sides.

    A heavy key's rows lie in a grid: each left row in one line of it, copied to
    all its columns, each right row in one column, copied to all lines. Every pair
    meets in exactly one cell, and no task holds all rows of a key. A row's line or
    column follows from its ``spread`` columns (of the left and of the right side), so
    a task that runs again gives the same. There are at most as many lines as the
    key has rows, so that a row has no more copies than it has matches. Keys that
    are NULL match nothing and are scattered. Columns are those of a join on
    ``keys``; no other may be on both sides.
    """
    keys = list(keys)
    grid = F.broadcast(_heavy(left, keys, "_lines").join(_heavy(right, keys, "_columns"), keys, "full"))
    one = F.lit(1)
    absent = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))

    def placed(df: DataFrame, own: str, other: str, columns: Sequence[str], mine: str, theirs: str) -> DataFrame:
        known = df.join(grid, keys, "left").select(*df.columns, "_lines", "_columns")
        number = F.pmod(F.xxhash64(*columns), F.when(absent, F.lit(HOT_SPREAD)).otherwise(F.coalesce(own, one)))
        copies = F.sequence(F.lit(0), F.coalesce(other, one) - 1)
        return known.select(
            *df.columns,
            number.cast("int").alias(mine),
            F.explode(copies).alias(theirs),
            (F.coalesce(other, one) == 1).alias(f"_alone{mine}"),
        )

    rows = placed(left, "_lines", "_columns", spread[0], "_line", "_column")
    others = placed(right, "_columns", "_lines", spread[1], "_column", "_line")
    joined = rows.join(others, [*keys, "_line", "_column"], how)
    # A copy without a match stays only if it is the row itself; if the key is heavy
    # on the other side, the row has its matches in other cells.
    met = F.col("_alone_line").isNotNull() & F.col("_alone_column").isNotNull()
    kept = met | F.coalesce("_alone_line", "_alone_column")
    fields = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return joined.where(kept).select(*keys, *fields)


def _cells(left: DataFrame, others: Sequence[DataFrame], keys: Sequence[str], lines: str, columns: Sequence[str]) -> DataFrame:
    """Over how many lines the rows of ``left`` of a key are to be spread, and over how
    many columns those of each other table, for the ``HOT_KEYS`` keys with most results
    that have more than one of either."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(name))

    counted = reduce(
        lambda df, k: df.join(counts(others[k], f"_n{k}"), list(keys), "left"), range(len(others)), counts(left, "_n")
    )
    found = [F.coalesce(f"_n{k}", F.lit(1)) for k in range(len(others))]
    # As double: the product of several counts may exceed a long.
    counted = counted.withColumn("_w", reduce(lambda a, b: a * b, found, F.col("_n").cast("double")))
    total = counted.agg(F.sum("_w")).scalar()
    split = [F.ceil(n / CELL_ROWS).cast("int").alias(c) for n, c in zip(found, columns)]
    share = F.ceil(F.col("_w") * HOT_KEYS / total)
    cells = counted.select(*keys, "_w", F.least("_n", share).cast("int").alias(lines), *split)
    heavy = cells.where(reduce(lambda a, b: a | b, (F.col(c) > 1 for c in [lines, *columns])))
    return heavy.orderBy(F.desc("_w"), *keys).limit(HOT_KEYS).drop("_w")


def left_join_repeated(
    left: DataFrame,
    others: Sequence[DataFrame],
    keys: Sequence[str],
    spread: Sequence[Sequence[str]],
) -> DataFrame:
    """Left joins of ``left`` to each of ``others`` in turn, all on ``keys``, of which
    some may own a large part of the rows of several tables.

    A heavy key's rows of ``left`` lie in lines, and the rows of the other tables, which
    should be the narrow ones, are copied to all of them: no task makes all results of a
    key, and a row of ``left`` moves once, whatever its matches. Only where another
    table has more than ``CELL_ROWS`` rows of a key these are in columns and the row is
    copied to each, one copy for so many matches. All joins are on the same columns, so
    nothing moves between them and no product of the others is ever stored. What is
    shuffled grows with the tables, not with the result; as its size says little of the
    result's, cells are dealt to ``CELL_TASKS`` tasks or more. A row's place follows from its
    ``spread`` columns (of ``left``, then of the others). Keys that are NULL match
    nothing and are scattered. Columns are those of joins on ``keys``; no other may be
    in two tables.
    """
    keys = list(keys)
    columns = [f"_columns{k}" for k in range(len(others))]
    places = [f"_column{k}" for k in range(len(others))]
    grid = F.broadcast(_cells(left, others, keys, "_lines", columns))
    one = F.lit(1)
    absent = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))

    def placed(df: DataFrame, size: str, place: str, by: Sequence[str]) -> DataFrame:
        """Each row in one place along its own size, copied along all others."""
        own = F.pmod(F.xxhash64(*by), F.coalesce(size, one)).cast("int")
        known = df.join(grid, keys, "left").withColumn(place, own)
        for n, at in zip(["_lines", *columns], ["_line", *places]):
            if at != place:
                copies = F.sequence(F.lit(0), F.coalesce(n, one) - 1)
                known = known.withColumn(at, F.explode(copies))
        return known

    # A text without key is in no cell of others; negative lines keep them apart.
    rows = placed(left, "_lines", "_line", spread[0])
    scattered = -1 - F.pmod(F.xxhash64(*spread[0]), F.lit(HOT_SPREAD)).cast("int")
    rows = rows.withColumn("_line", F.when(absent, scattered).otherwise(F.col("_line")))
    cell = [*keys, "_line", *places]
    # With a number of its own, so that tasks are not put together by what they read.
    tasks = max(CELL_TASKS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select(*left.columns, "_line", *places, *columns).repartition(tasks, *cell)
    met = []
    for k, other in enumerate(others):
        own = placed(other.dropna(subset=keys), columns[k], places[k], spread[k + 1])
        own = own.select(*other.columns, "_line", *places, F.lit(True).alias(f"_met{k}"))
        rows = rows.join(own, cell, "left")
        # With more columns than one there are matches, if not in this one.
        met.append(F.col(f"_met{k}").isNotNull() | (F.coalesce(columns[k], one) == 1))
    fields = [c for df in [left, *others] for c in df.columns if c not in keys]
    return rows.where(reduce(lambda a, b: a & b, met)).select(*keys, *fields)
