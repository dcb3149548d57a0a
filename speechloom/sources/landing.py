"""Granules as the service delivers them: one JSON record each, with the text in
the record or in a file of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.schema import GRANULES, conform

# A member's attributes may be texts, lists or objects; they are kept as JSON text.
API_RECORDS = """
  package struct<packageId: string, congress: string>, granuleId string, granuleLink string,
  summary struct<download: struct<txtLink: string>, congress: string,
    members: array<map<string, string>>>,
  html string, arrivalSeq long
"""
MEMBER_FIELDS = ("name", "party", "state", "bioguideId")
# A text's file is named after its granule.
TEXT_NAME = r"^(.*)\.html?$"


def _member(found: Column) -> Column:
    """A member's fields. One listed without a name is an unknown speaker; one
    whose name is null has no name."""
    named = F.coalesce(F.map_contains_key(found, "name"), F.lit(True))
    name = F.when(named, found["name"]).otherwise(fv.UNKNOWN_SPEAKER)
    rest = [found[field].alias(field) for field in MEMBER_FIELDS[1:]]
    return F.when(found.isNotNull(), F.struct(name.alias("name"), *rest))


def _attributes(member: Column) -> Column:
    """The reverse of :func:`_member`."""
    pairs = [part for field in MEMBER_FIELDS for part in (F.lit(field), member[field])]
    return F.when(member.isNotNull(), F.create_map(*pairs))


def from_api(records: DataFrame) -> DataFrame:
    """Records in the service's own shape as granules."""
    summary = F.when(
        F.col("summary").isNotNull(),
        F.struct(
            F.col("summary.download.txtLink").alias("txt_link"),
            F.col("summary.congress").alias("congress"),
            F.transform("summary.members", _member).alias("members"),
        ),
    )
    return conform(
        records.select(
            F.col("package.packageId").alias("package_id"),
            F.col("package.congress").alias("package_congress"),
            F.col("granuleId").alias("granule_id"),
            summary.alias("summary"),
            "html",
            F.col("arrivalSeq").alias("arrival_seq"),
        ),
        GRANULES,
    )


def to_api(granules: DataFrame) -> DataFrame:
    """Granules in the service's shape; the reverse of :func:`from_api`."""
    summary = F.when(
        F.col("summary").isNotNull(),
        F.struct(
            F.struct(F.col("summary.txt_link").alias("txtLink")).alias("download"),
            F.col("summary.congress").alias("congress"),
            F.transform("summary.members", _attributes).alias("members"),
        ),
    )
    return granules.select(
        F.struct(F.col("package_id").alias("packageId"), F.col("package_congress").alias("congress")).alias("package"),
        F.col("granule_id").alias("granuleId"),
        summary.alias("summary"),
        "html",
        F.col("arrival_seq").alias("arrivalSeq"),
    )


def read_landed(spark: SparkSession, records: str, texts: str | None = None) -> DataFrame:
    """Granules of landed records. With ``texts``, a folder of HTML files, a record
    without a text gets that of the file named after it, if there is one."""
    found = spark.read.schema(API_RECORDS).json(records)
    if texts is not None:
        pages = spark.read.option("recursiveFileLookup", True).text(texts, wholetext=True)
        pages = pages.select(
            F.regexp_extract("_metadata.file_name", TEXT_NAME, 1).alias("granuleId"),
            F.col("value").alias("_text"),
        )
        found = found.join(pages, "granuleId", "left")
        found = found.withColumn("html", F.coalesce("html", "_text"))
    return from_api(found)
