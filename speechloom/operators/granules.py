"""From landed granules to speech rows, with an account of what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions import records

_SKIP_REASONS = [fv.NOT_FLOOR, fv.MATTER, fv.EMPTY]


def skip_by_id(granule_id: Column | str) -> Column:
    """Why a granule is out by its id alone, NULL if it is in."""
    granule_id = F.col(granule_id) if isinstance(granule_id, str) else granule_id
    return F.when(~granule_id.rlike("|".join(fv.FLOOR_MARKERS)), fv.NOT_FLOOR).when(
        granule_id.rlike("|".join(fv.MATTER_MARKERS)), fv.MATTER
    )


def filter_granules(granules: DataFrame) -> DataFrame:
    """Ids with status and reason of the filter on ids."""
    reason = skip_by_id("granule_id")
    return granules.select(
        "granule_id", F.when(reason.isNull(), "KEEP").otherwise("SKIP").alias("status"),
        reason.alias("reason"),
    )


def granule_outcomes(granules: DataFrame) -> DataFrame:
    """Every granule with its clean text, a status (SUCCESS, SKIP, ERROR) and a
    reason. Texts are cleaned only for granules that pass the cheap checks."""
    early = (
        F.when(skip_by_id("granule_id").isNotNull(), skip_by_id("granule_id"))
        .when(F.col("summary").isNull(), fv.NO_METADATA)
        .when(F.coalesce("summary.txt_link", F.lit("")) == "", fv.NO_LINK)
        .when(F.col("html").isNull(), fv.NO_TEXT)
    )
    text = records.clean_text(records.html_to_text("html"))
    too_short = F.length("text") < fv.MIN_GRANULE_CHARS
    return (
        granules.withColumn("early", early)
        # exploding an array of one is a border that no later filter crosses,
        # so a text is cleaned once whatever is asked about it
        .select("*", F.explode(F.array(F.when(F.col("early").isNull(), text))).alias("text"))
        .withColumn("reason", F.coalesce("early", F.when(too_short, fv.EMPTY)))
        .withColumn(
            "status",
            F.when(F.col("reason").isNull(), "SUCCESS")
            .when(F.col("reason").isin(_SKIP_REASONS), "SKIP")
            .otherwise("ERROR"),
        )
        .drop("early", "html")
    )


def speech_rows(outcomes: DataFrame) -> DataFrame:
    """Outcomes with the production columns; without text unless they succeeded."""
    member = F.get("summary.members", F.lit(0))
    has_member = F.coalesce(F.size("summary.members") > 0, F.lit(False))
    listed = records.member_name(records.flatten_metadata(member["name"]))

    def of_member(field: str) -> Column:
        return F.when(has_member, records.flatten_metadata(member[field])).otherwise(fv.UNKNOWN)

    congress = records.congress_number(F.col("package_congress"), F.col("summary.congress"))
    return outcomes.select(
        "package_id",
        "status",
        "reason",
        F.col("granule_id").alias("speech_id"),
        F.when(F.col("status") == "SUCCESS", F.col("text")).alias("speech"),
        records.package_date("package_id").alias("date"),
        F.when(has_member, records.digits_as_number(of_member("bioguideId")))
        .otherwise(F.lit(-1).cast("bigint"))
        .alias("speakerid"),
        F.when(has_member, listed).otherwise(records.opening_name("text")).alias("name"),
        has_member.cast("int").alias("is_mapped"),
        of_member("party").alias("party"),
        of_member("state").alias("state_x"),
        congress.try_cast("int").alias("congress_session"),
        "arrival_seq",
    ).select("*", "name.*").drop("name")


def granule_speeches(granules: DataFrame) -> DataFrame:
    """Granules to production rows in one plan."""
    saved = speech_rows(granule_outcomes(granules)).where(F.col("status") == "SUCCESS")
    return saved.select(*fv.PRODUCTION_COLUMNS)


def ingest_audit(outcomes: DataFrame) -> DataFrame:
    """Saved, skipped and failed granules per package."""
    return outcomes.groupBy("package_id").agg(
        F.count_if(F.col("status") == "SUCCESS").alias("saved"),
        F.count_if(F.col("status") == "SKIP").alias("skipped"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
    )


def ingest_reasons(outcomes: DataFrame) -> DataFrame:
    """Granules per status and reason."""
    return outcomes.groupBy("status", "reason").agg(F.count("*").alias("n_granules"))


def ingest_errors(outcomes: DataFrame) -> DataFrame:
    """One message per failed granule."""
    return outcomes.where(F.col("status") == "ERROR").select(
        "package_id",
        "granule_id",
        F.concat_ws(" - ", "granule_id", "reason").alias("message"),
    )
