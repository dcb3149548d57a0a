"""Questions put to the speech table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions.cards import party_name
from speechloom.functions.text import mentions, mentions_any
from speechloom.operators.denoise import bigram_substantive
from speechloom.plans.ranking import top_per_group


def _debate_only(speeches: DataFrame, wanted: bool) -> DataFrame:
    # unlabelled speeches are left out together with procedural ones
    return speeches.where(F.col("is_procedure") == 0) if wanted else speeches


def speech_by_id(speeches: DataFrame, speech_id: str) -> DataFrame:
    """One speech's record."""
    return speeches.where(F.col("speech_id") == str(speech_id).strip()).select(*fv.CARD_COLUMNS)


def speeches_by_id(speeches: DataFrame, ids: DataFrame, key: str = "speech_id") -> DataFrame:
    """The records of all speeches a table asks for."""
    wanted = ids.select(F.trim(key).alias("speech_id"))
    return speeches.join(wanted, "speech_id", "left_semi").select(*fv.CARD_COLUMNS)


def phrase_trend(speeches: DataFrame, phrase: str, debate_only: bool = True) -> DataFrame:
    """Speeches per year and main party that mention a phrase."""
    return (
        _debate_only(speeches, debate_only)
        .where(F.col("party").isin(fv.MAIN_PARTIES) & mentions("speech", phrase))
        .groupBy(F.expr("cast(date div 10000 as int)").alias("year"), "party")
        .agg(F.count("*").alias("mention_count"))
        .select("year", "party", party_name("party").alias("party_name"), "mention_count")
        .orderBy("year", "party")
    )


def partisan_share(speeches: DataFrame, phrase: str) -> DataFrame:
    """Per session, how many debate speeches of each main party mention a
    phrase, and the second party's share."""
    return (
        _debate_only(speeches, True)
        .where(F.col("party").isin(fv.MAIN_PARTIES) & mentions("speech", phrase))
        .groupBy("congress_session")
        .agg(
            F.count_if(F.col("party") == "D").alias("D_count"),
            F.count_if(F.col("party") == "R").alias("R_count"),
            F.count("*").alias("total"),
        )
        .withColumn("rep_share", F.round(F.try_divide("R_count", "total"), 6))
        .orderBy("congress_session")
    )


def session_browse(
    speeches: DataFrame, session: int, limit: int = 20, debate_only: bool = True
) -> DataFrame:
    """The first records of a session."""
    return (
        _debate_only(speeches, debate_only)
        .where(F.col("congress_session") == session)
        .select(*fv.CARD_COLUMNS)
        .orderBy("speech_id")
        .limit(limit)
    )


def any_phrase_trend(speeches: DataFrame, phrases: Sequence[str] = fv.ANY_PHRASES) -> DataFrame:
    """Speeches per session that mention at least one of the phrases."""
    return (
        speeches.where(mentions_any("speech", phrases))
        .groupBy("congress_session")
        .agg(F.count("*").alias("mention_count"))
        .orderBy("congress_session")
    )


# --------------------------------------------- substantive hits of a phrase


def substantive_hits(
    speeches: DataFrame, phrase: str, noise_bigrams: Sequence[str]
) -> DataFrame:
    """Speeches that mention the phrase and are more than procedure."""
    return speeches.where(mentions("speech", phrase.lower())).where(
        bigram_substantive(noise_bigrams)
    )


def _party_counts() -> list[Column]:
    d, r = [F.count_if(F.col("party") == p) for p in fv.MAIN_PARTIES]
    return [d.alias("D"), r.alias("R"), (d + r).alias("total")]


def _with_share(stats: DataFrame) -> DataFrame:
    # NULL, not NaN, where neither main party spoke
    return stats.withColumn("rep_share", F.round(F.try_divide("R", "total"), 6))


def session_party_pivot(hits: DataFrame) -> DataFrame:
    """Hits per session and main party, side by side, with the second party's
    share. Sessions where only other speakers hit are kept with zeros."""
    known = hits.where(F.col("party").isNotNull())
    return _with_share(known.groupBy("congress_session").agg(*_party_counts()))


def compare_phrases(
    speeches: DataFrame, phrases: Sequence[str], noise_bigrams: Sequence[str]
) -> DataFrame:
    """The pivot for several phrases from a single scan of the texts."""
    lowered = [p.lower() for p in phrases]
    matched = F.array_compact(
        F.array(*[F.when(mentions("speech", p), F.lit(p)) for p in lowered])
    )
    hits = (
        speeches.where(F.col("party").isNotNull() & mentions_any("speech", lowered))
        .where(bigram_substantive(noise_bigrams))
        .select("congress_session", "party", F.explode(matched).alias("phrase"))
    )
    return _with_share(hits.groupBy("phrase", "congress_session").agg(*_party_counts()))


def polarized_sessions(pivot: DataFrame, k: int = 5) -> DataFrame:
    """The sessions with the most one-sided share; undefined shares rank last."""
    return (
        pivot.withColumn("gap", F.round(F.abs(F.col("rep_share") - 0.5), 6))
        .orderBy(F.desc_nulls_last("gap"), "congress_session")
        .limit(k)
    )


def available_sessions(hits: DataFrame) -> DataFrame:
    return hits.select("congress_session").distinct().orderBy(F.desc("congress_session"))


def speech_gallery(
    hits: DataFrame,
    phrase: str,
    k: int = 5,
    session: int | None = None,
    speeches: DataFrame | None = None,
) -> DataFrame:
    """In one session, or in every session, the speeches that use the phrase most, with the phrase
    highlighted. The phrase is lower-case, the texts are not: only lower-case
    uses count. The phrase counts as a pattern but is highlighted literally.

    Speeches are ranked without their texts. Those of the winners are fetched from
    ``speeches``, the table the hits are from (by default the hits themselves)."""
    phrase = phrase.lower()
    if session is not None:
        hits = hits.where(F.col("congress_session") == session)
    ranked = hits.select(
        "congress_session",
        "speech_id",
        "party",
        F.regexp_count("speech", F.lit(phrase)).alias("relevance"),
        F.md5("speech").alias("digest"),
    )
    order = [F.desc("relevance"), F.asc("speech_id"), F.asc("digest")]
    winners = top_per_group(ranked, ["congress_session"], order, k)
    # k rows for each session, of which the table has a folder each.
    wanted = winners.select(
        F.col("congress_session").alias("_session"), F.col("speech_id").alias("_id"), F.col("digest").alias("_digest")
    ).distinct()
    source = hits if speeches is None else speeches
    same = source["congress_session"].eqNullSafe(F.col("_session")) & source["speech_id"].eqNullSafe(F.col("_id"))
    texts = (
        source.join(F.broadcast(wanted), same)
        .where(F.md5("speech") == F.col("_digest"))
        .groupBy("_digest")
        .agg(F.first("speech").alias("speech"))
    )
    gallery = winners.join(texts, F.col("digest") == F.col("_digest")).select(
        "congress_session",
        "rank",
        "speech_id",
        "party",
        "relevance",
        F.replace("speech", F.lit(phrase), F.lit(f"**{phrase.upper()}**")).alias("highlighted"),
    )
    return gallery.orderBy("congress_session", "rank")
