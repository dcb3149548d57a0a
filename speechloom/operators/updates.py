"""Changing rows of the speech table by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.plans.ranking import latest_per_key


def upsert_speeches(
    current: DataFrame,
    updates: DataFrame,
    newest_by: Sequence[str],
    key: str = "speech_id",
    keep_labels: bool = False,
) -> DataFrame:
    """Replace or add speeches; of several updates to one key the one
    with the largest ``newest_by`` counts. Replaced rows lose what the update does not carry, their
    label included, unless ``keep_labels``. A key that is NULL names no speech: it
    replaces none, and all updates without a key are added."""
    changed = updates.select(key).where(F.col(key).isNotNull())
    newest = (
        latest_per_key(updates.where(F.col(key).isNotNull()), key, newest_by)
        .unionByName(updates.where(F.col(key).isNull()))
        .select(*[c for c in updates.columns if c in current.columns])
    )
    if keep_labels:
        # a key found twice in the table still has one label
        labels = current.join(changed, key, "left_semi").groupBy(key)
        labels = labels.agg(F.max("is_procedure").alias("is_procedure"))
        newest = newest.drop("is_procedure").join(labels, key, "left")
    return current.join(changed, key, "left_anti").unionByName(newest, allowMissingColumns=True)


def apply_labels(
    speeches: DataFrame,
    labels: DataFrame,
    key: str = "speech_id",
    label: str = "is_procedure",
    open_only: bool = False,
) -> DataFrame:
    """Set new labels by key and keep all others; with ``open_only`` a row that has a
    label keeps it. Of several labels of a key the largest counts."""
    new = labels.groupBy(key).agg(F.max(label).alias("_new"))
    order = [label, "_new"] if open_only else ["_new", label]
    return (
        speeches.join(new, key, "left")
        .withColumn(label, F.coalesce(*order))
        .select(*speeches.columns)
    )


def unprocessed(packages: DataFrame, done: DataFrame, key: str = "package_id") -> DataFrame:
    """Packages that the tracker does not list, each once."""
    return packages.select(key).distinct().join(done.select(key), key, "left_anti")
