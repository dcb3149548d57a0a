"""Helpers that the operators of this folder share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LAST_ID = (1 << 63) - 1


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table without columns whose names the operator gives to its own."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def utf8(column: str) -> Column:
    """A text as UTF-8 bytes."""
    return F.col(f"`{column}`").cast("string").cast("binary")


def id_or_last(column: str) -> Column:
    """An id as a number; rows without one come after all others."""
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(LAST_ID))


def schema_of(df: DataFrame, extra: str) -> StructType:
    """The table's columns followed by others, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(extra).fields])


def batch_of(table: pa.RecordBatch | pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
    """The table's columns followed by others."""
    table = pa.table(table) if isinstance(table, pa.Table) else pa.Table.from_batches([table])
    for name, values in columns.items():
        table = table.append_column(name, values)
    return table


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Spark send texts to its workers in batches of few rows, as texts may be
    long. A lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def portions(batches, rows: int = 256):
    """The batches in portions of a few rows, so that few texts are objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes checkpoint() usable. The folder is the shared one the cluster names
    in ``spark.checkpoint.dir``; only a local session may do without."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "checkpoints")
    context.setCheckpointDir(shared)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the checkpoint folder."""
    checkpoint_folder(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The table, computed and written to the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
