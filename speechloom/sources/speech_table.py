"""The speech table on disk: Parquet, one folder per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from speechloom.operators.updates import upsert_speeches
from speechloom.schema import SPEECHES, conform

PARTITION = "congress_session"


def _writer(df: DataFrame) -> DataFrameWriter:
    # Rebalancing splits a large session over many tasks and joins small ones;
    # sorted files let a lookup by speech_id skip row groups.
    laid_out = (
        conform(df).hint("rebalance", PARTITION).sortWithinPartitions(PARTITION, "speech_id")
    )
    return laid_out.write.partitionBy(PARTITION)


def append_speeches(df: DataFrame, path: str) -> None:
    _writer(df).mode("append").parquet(path)


def replace_sessions(df: DataFrame, path: str) -> None:
    """Replace the sessions found in ``df`` and leave all others alone. Columns
    that ``df`` lacks are NULL in the replaced rows. The old rows go when the
    new ones are committed, so a failed load deletes nothing."""
    _writer(df).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def upsert_sessions(
    spark: SparkSession,
    updates: DataFrame,
    path: str,
    newest_by: Sequence[str],
    key: str = "speech_id",
    keep_labels: bool = False,
) -> None:
    """Upsert into the table at ``path``. Only sessions that lose or gain a row
    are read whole and written; the files of all others stay. A run that failed
    can be repeated (labels of speeches that change their session are safe only
    until it commits), and a repeated one changes nothing."""
    table = read_speeches(spark, path)
    held = table.join(updates.select(key), key, "left_semi").select(PARTITION)
    # as many values as the table has folders, at most, and new sessions
    touched = {r[0] for r in held.union(updates.select(PARTITION)).distinct().collect()}
    if not touched:
        return
    wanted = F.col(PARTITION).isin(sorted(touched - {None}))
    if None in touched:
        wanted = wanted | F.col(PARTITION).isNull()
    changed = upsert_speeches(table.where(wanted), updates, newest_by, key, keep_labels)
    filled = {r[0] for r in changed.select(PARTITION).distinct().collect()}
    replace_sessions(changed, path)
    # A session all of whose speeches moved to others has no rows to replace its own.
    for session in touched - filled:
        name = "__HIVE_DEFAULT_PARTITION__" if session is None else session
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PARTITION}={name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_speeches(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.schema(SPEECHES).parquet(path))
