"""Display expressions for a single speech record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom import fixed_values as fv


def party_name(party: Column | str) -> Column:
    """Full name of a main party, NULL for any other."""
    party = F.col(party) if isinstance(party, str) else party
    named = None
    for short, full in fv.PARTY_NAMES.items():
        named = F.when(party == short, full) if named is None else named.when(party == short, full)
    return named


def label_badge(label: Column | str) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label == 1, fv.PROCEDURE_BADGE).when(label == 0, fv.DEBATE_BADGE).otherwise(fv.UNLABELLED_BADGE)


def speech_cards(speeches: DataFrame) -> DataFrame:
    """One display card per speech; absent fields show their placeholder."""

    def field(name: str, placeholder: str) -> Column:
        value = F.col(name).cast("string") if name in speeches.columns else F.lit(None)
        return F.coalesce(value, F.lit(placeholder))

    label = F.col("is_procedure") if "is_procedure" in speeches.columns else F.lit(None)
    return speeches.select(
        field("speech_id", fv.UNKNOWN).alias("speech_id"),
        field("speaker", fv.UNKNOWN_SPEAKER).alias("speaker"),
        label_badge(label).alias("badge"),
        field("date", fv.NOT_AVAILABLE).alias("date"),
        field("party", fv.UNKNOWN).alias("party"),
        F.concat(field("congress_session", fv.NOT_AVAILABLE), F.lit("th")).alias("session"),
        field("state_x", fv.NOT_AVAILABLE).alias("state"),
        field("speech", "").alias("transcript"),
    )
