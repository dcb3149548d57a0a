"""Incremental ingest of landed granules.

Each micro-batch is written once, to its own folder, and nothing already
written is touched, so the cost of a batch is the size of the batch. A batch
that is run again after a failure overwrites its own folder. Readers see the
newest version of every speech; ``fold`` takes the batches into a base, of which
only the sessions they touch are written, and ``compact`` writes a new base.

With a base, ``ingest`` folds each batch itself and then enters it in a ledger beside
the base. A batch in the ledger is not folded again; one that failed before it got
there is, and folding twice is the same as folding once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.operators.granules import granule_outcomes, ingest_audit, speech_rows
from speechloom.operators.updates import upsert_speeches
from speechloom.plans.ranking import latest_per_key
from speechloom.schema import GRANULES, SPEECHES, conform
from speechloom.sources.landing import API_RECORDS, from_api
from speechloom.sources.speech_table import append_speeches, read_speeches, upsert_sessions

_CHANGES = (
    "package_id string, reason string, arrival_seq long, "
    + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SPEECHES)
    + ", batch long, status string"
)
_NEWEST = ["batch", "arrival_seq", "speech"]


def ingest(
    spark: SparkSession,
    landing: str,
    changes: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    file_format: str = "parquet",
    api_shape: bool = False,
    base: str | None = None,
) -> None:
    """Ingest all files landed since the last run, then stop. The checkpoint
    remembers which files are done. Files hold granules or, with ``api_shape``,
    records as the service delivers them. A ``base`` is kept current, batch by
    batch; it need not exist yet."""

    def store(batch: DataFrame, batch_id: int) -> None:
        (
            speech_rows(granule_outcomes(from_api(batch) if api_shape else batch))
            .write.mode("overwrite")
            .partitionBy("status")
            .parquet(f"{changes}/batch={batch_id}")
        )
        if base is not None and not _exists(spark, f"{ledger(base)}/batch={batch_id}/_SUCCESS"):
            _fold_batch(spark, f"{changes}/batch={batch_id}", base)
            entry = spark.range(0, 1, 1, 1).select(F.current_timestamp().alias("folded_at"))
            entry.write.mode("overwrite").parquet(f"{ledger(base)}/batch={batch_id}")

    query = (
        spark.readStream.schema(API_RECORDS if api_shape else GRANULES)
        .format(file_format)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ledger(base: str) -> str:
    """Where the batches that a base holds are entered."""
    return f"{base.rstrip('/')}.ledger"


def folded_batches(spark: SparkSession, base: str) -> DataFrame:
    """The batches a base holds, with the time each was entered."""
    return spark.read.schema("folded_at timestamp, batch long").parquet(ledger(base))


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _fold_batch(spark: SparkSession, batch: str, base: str) -> None:
    """Apply one batch, from its own folder. Batches come in order, so its rows are
    newer than all in the base."""
    saved = spark.read.schema(_CHANGES).parquet(batch).where(F.col("status") == "SUCCESS")
    newest_by = [c for c in _NEWEST if c != "batch"]
    if _exists(spark, base):
        upsert_sessions(spark, saved, base, newest_by)
    else:
        append_speeches(latest_per_key(saved, "speech_id", newest_by), base)


def read_changes(spark: SparkSession, changes: str, after_batch: int = -1) -> DataFrame:
    """Outcomes of all granules of the batches after the given one."""
    return spark.read.schema(_CHANGES).parquet(changes).where(F.col("batch") > after_batch)


def current_speeches(
    spark: SparkSession, changes: str, base: str | None = None, after_batch: int = -1
) -> DataFrame:
    """The speech table as of now: the base with all later batches applied."""
    saved = read_changes(spark, changes, after_batch).where(F.col("status") == "SUCCESS")
    if base is None:
        return conform(latest_per_key(saved, "speech_id", _NEWEST))
    return upsert_speeches(read_speeches(spark, base), saved, _NEWEST)


def fold(spark: SparkSession, changes: str, base: str, after_batch: int = -1) -> None:
    """Apply all later batches to the base, where it is. Sessions that they do
    not touch keep their files; doing it again changes nothing."""
    saved = read_changes(spark, changes, after_batch).where(F.col("status") == "SUCCESS")
    upsert_sessions(spark, saved, base, _NEWEST)


def compact(
    spark: SparkSession, changes: str, target: str, base: str | None = None, after_batch: int = -1
) -> None:
    """Write the current table to a new folder. A folder that is being read is
    never overwritten; readers move to the new one when it is complete."""
    append_speeches(current_speeches(spark, changes, base, after_batch), target)


def processed_packages(spark: SparkSession, changes: str) -> DataFrame:
    """The tracker: every package seen so far."""
    return read_changes(spark, changes).select("package_id").distinct()


def audit(spark: SparkSession, changes: str) -> DataFrame:
    return ingest_audit(read_changes(spark, changes))
