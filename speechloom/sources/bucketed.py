"""The speech table in buckets by id, for tables that are often changed by id.

Rows of an id lie in one bucket, so an upsert, new labels or an anti join send the
changes to the buckets and leave the table's texts where they are. Rows that
would overfill a bucket are spread instead: those without an id, and those of an
id that owns more than a bucket's share of the rows. There are fewer such ids
than buckets; they are kept in a table of their own and joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.plans.rows import row_digest

KEY, PLACE = "speech_id", "_place"


def _hot(spark: SparkSession, name: str) -> DataFrame:
    # fewer rows than buckets, by how they were chosen
    return F.broadcast(spark.table(f"{name}_hot"))


def _placed(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with what decides their bucket: the id, or a digest of the row where the
    id is absent or hot. Equal rows of such an id share a bucket."""
    spread = F.concat(F.lit("\u0000"), row_digest(*df.columns))
    marked = df.join(hot.select(KEY, F.lit(True).alias("_hot")), KEY, "left").select(*df.columns, "_hot")
    place = F.when(F.col(KEY).isNull() | F.col("_hot").isNotNull(), spread).otherwise(F.col(KEY))
    return marked.withColumn(PLACE, place).drop("_hot")


def _save(placed: DataFrame, name: str, path: str, buckets: int) -> None:
    writer = placed.write.mode("error").option("path", path)
    writer.bucketBy(buckets, PLACE).sortBy(PLACE).saveAsTable(name)


def lay_out(df: DataFrame, name: str, path: str, buckets: int) -> None:
    """Write a table in buckets as ``name``, its files below ``path``. This is the only
    time that its texts are shuffled. Ids are counted without texts."""
    ids = df.select(KEY)
    total = ids.count()
    counts = ids.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") * buckets > total).select(KEY)
    hot.coalesce(1).write.mode("error").option("path", f"{path}/hot").saveAsTable(f"{name}_hot")
    placed = _placed(df, _hot(df.sparkSession, name))
    _save(placed.repartition(buckets, PLACE), name, f"{path}/rows", buckets)


def read(spark: SparkSession, name: str) -> DataFrame:
    """The rows of a table in buckets."""
    return spark.table(name).drop(PLACE)


def _newest(updates: DataFrame, newest_by: Sequence[Column | str]) -> DataFrame:
    """One update of each id: that with the largest ``newest_by``; of several such, that
    with the largest digest of its text. Updates are ranked without their texts, and
    only the winners' move."""
    order = F.struct(*newest_by, F.md5("speech").alias("_digest"))
    ranked = updates.withColumn("_order", order)
    best = ranked.groupBy(KEY).agg(F.max("_order").alias("_order"))
    won = ranked.join(best, [KEY, "_order"], "left_semi")
    return won.drop("_order").dropDuplicates([KEY])


def upserted(
    spark: SparkSession,
    name: str,
    updates: DataFrame,
    newest_by: Sequence[Column | str],
    buckets: int,
    keep_labels: bool = False,
) -> DataFrame:
    """The table's rows after an upsert, still by bucket. Every row of an id that has an
    update goes, and its newest update comes. Updates without an id are all added, rows
    without one all stay. With ``keep_labels`` an update takes the largest label that the
    id had; else its own, if it has one."""
    table, hot = spark.table(name), _hot(spark, name)
    fields = [f for f in table.columns if f != PLACE]
    if keep_labels:
        updates = updates.drop("is_procedure")
    named = _newest(updates.where(F.col(KEY).isNotNull()), newest_by)
    keys = named.select(KEY)
    by_bucket = keys.select(F.col(KEY).alias(PLACE)).repartition(buckets, PLACE)
    of_hot = F.broadcast(keys.join(hot, KEY, "left_semi"))
    if keep_labels:
        # those of hot ids from wherever they lie, those of the others from their bucket
        label = F.max("is_procedure").alias("is_procedure")
        there = table.select(KEY, PLACE, "is_procedure")
        labels = there.join(by_bucket, PLACE, "left_semi").groupBy(PLACE).agg(label)
        labels = labels.select(F.col(PLACE).alias(KEY), "is_procedure")
        hot_labels = there.join(of_hot, KEY, "left_semi").groupBy(KEY).agg(label)
        named = named.join(labels.unionByName(hot_labels), KEY, "left")
    kept = table.join(by_bucket, PLACE, "left_anti").join(of_hot, KEY, "left_anti")
    new = named.unionByName(updates.where(F.col(KEY).isNull()), allowMissingColumns=True)
    present = set(new.columns)
    new = new.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table.schema
            if f.name in fields
        ]
    )
    placed = _placed(new, hot).repartition(buckets, PLACE)
    return kept.select(*fields, PLACE).unionByName(placed)


def labelled(
    spark: SparkSession, name: str, labels: DataFrame, buckets: int, label: str = "is_procedure"
) -> DataFrame:
    """The table's rows with new labels (of several of an id, the largest), still by
    bucket; a row whose id has no new one keeps its own."""
    table, hot = spark.table(name), _hot(spark, name)
    new = labels.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.max(label).alias("_new"))
    by_bucket = new.select(F.col(KEY).alias(PLACE), "_new").repartition(buckets, PLACE)
    of_hot = new.join(hot, KEY, "left_semi").withColumnRenamed("_new", "_hot_new")
    joined = table.join(by_bucket, PLACE, "left").join(F.broadcast(of_hot), KEY, "left")
    value = F.coalesce("_new", "_hot_new", label)
    return joined.withColumn(label, value).select(*table.columns)


def replace_table(
    spark: SparkSession, rows: DataFrame, name: str, new_name: str, path: str, buckets: int
) -> None:
    """Write what :func:`upserted` or :func:`labelled` gave as the next table. Every task
    holds rows of one bucket, so nothing is shuffled; the old table stays for its readers."""
    hot = spark.table(f"{name}_hot")
    hot.coalesce(1).write.mode("error").option("path", f"{path}/hot").saveAsTable(f"{new_name}_hot")
    _save(rows, new_name, f"{path}/rows", buckets)
