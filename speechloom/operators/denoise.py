"""Telling procedural noise from debate by rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions.text import SPACE, let, ngrams, space_tokens
from speechloom.plans.bitmap import hash_bits, may_hold
from speechloom.plans.exploding import explode_array
from speechloom.plans.literals import literal_table
from speechloom.plans.rows import repeated, row_digest


def purge_label(
    phrases: Sequence[str] = fv.PURGE_PHRASES, max_chars: int = fv.PURGE_MAX_CHARS
) -> Column:
    """Label 1 for short unlabelled speeches that use a procedural phrase; all
    other labels stay as they are. Phrases are patterns: a dot matches any
    character."""
    label, speech = F.col("is_procedure"), F.col("speech")
    # cheap tests first: most texts are never scanned
    hit = label.isNull() & (F.length(speech) < max_chars) & F.lower(speech).rlike("|".join(phrases))
    return F.when(hit, 1).otherwise(label)


def keyword_purge(speeches: DataFrame, phrases: Sequence[str] = fv.PURGE_PHRASES) -> DataFrame:
    return speeches.withColumn("is_procedure", purge_label(phrases))


def zero_shot_label(
    top_label: Column | str = "top_label",
    score: Column | str = "score",
    threshold: float = fv.CONFIDENCE_THRESHOLD,
) -> Column:
    """1 if procedure is the top label with a score above the threshold, else 0."""
    top_label = F.col(top_label) if isinstance(top_label, str) else top_label
    score = F.col(score) if isinstance(score, str) else score
    return F.when((top_label == fv.PROCEDURE_LABEL) & (score > threshold), 1).otherwise(0)


def label_progress(speeches: DataFrame, rows_per_minute: int = fv.ROWS_PER_MINUTE) -> DataFrame:
    """How far labelling has come and how long the rest takes."""
    minutes = F.col("remaining") / F.lit(rows_per_minute)
    return (
        speeches.agg(
            F.count("speech_id").alias("total"),
            F.count(F.when(F.col("is_procedure").isNotNull(), F.col("speech_id"))).alias("done"),
        )
        .withColumn("remaining", F.col("total") - F.col("done"))
        .withColumns(
            {
                "percent": F.round(F.try_divide("done", "total") * 100, 6),
                "minutes_left": F.round(minutes, 6),
                "hours_left": F.round(minutes / 60, 6),
                "days_left": F.round(minutes / 60 / 24, 6),
            }
        )
    )


# -------------------------------------------------------- substantive rules


def intro_substantive(
    speech: Column | str = "speech",
    phrases: Sequence[str] = fv.INTRO_PHRASES,
    min_chars: int = fv.SUBSTANTIVE_MIN_CHARS,
    intro_chars: int = fv.INTRO_CHARS,
) -> Column:
    """Long enough, and the opening words name no procedure."""
    speech = F.col(speech) if isinstance(speech, str) else speech
    # lower-casing never shortens a text, so these characters hold the intro
    opening = F.regexp_extract(speech, f"(?s)^{SPACE}*+(.{{0,{intro_chars}}})", 1)
    intro = F.substring(F.lower(opening), 1, intro_chars)
    opens_with = F.lit(False)
    for phrase in phrases:
        opens_with = opens_with | F.contains(intro, F.lit(phrase))
    return (F.length(speech) >= min_chars) & ~opens_with


def bigram_substantive(
    noise_bigrams: Sequence[str],
    speech: Column | str = "speech",
    min_words: int = fv.BIGRAM_MIN_WORDS,
    noise_share: float = fv.BIGRAM_NOISE_SHARE,
) -> Column:
    """At least ``min_words`` words, and noise bigrams number under
    ``noise_share`` of the words. False for NULL texts. The rule looks at one
    text at a time, so nothing is shuffled."""
    speech = F.col(speech) if isinstance(speech, str) else speech
    noise = sorted(set(noise_bigrams))
    verdict = let(
        space_tokens(F.lower(speech)),
        lambda words: (F.size(words) >= min_words)
        & (
            F.size(F.filter(ngrams(words, 2), lambda b: b.isin(noise))) / F.size(words)
            < noise_share
        ),
    )
    return F.coalesce(verdict, F.lit(False))


def bigram_substantive_table(
    speeches: DataFrame,
    noise_bigrams: DataFrame,
    key: str = "speech_id",
    min_words: int = fv.BIGRAM_MIN_WORDS,
    noise_share: float = fv.BIGRAM_NOISE_SHARE,
) -> DataFrame:
    """The same rule against a table of noise bigrams (column ``bigram``) that
    may be too large for a literal list: (key, is_substantive), a row for each
    speech, whatever its id."""
    # Of a speech's bigrams only those that may be noise get past the task that reads
    # it. An empty bigram, which no text has, stands for the speech, so that those
    # without noise stay. Equal speeches are added up together and parted at the end.
    itself = F.array(F.lit(""))
    empty = literal_table(speeches.sparkSession, [("",)], ["bigram"])
    noise = noise_bigrams.select("bigram").where(F.col("bigram") != "").unionByName(empty)
    some = hash_bits(noise_bigrams, "bigram")
    words = speeches.select(
        key,
        row_digest(key, "speech").alias("row"),
        space_tokens(F.lower("speech")).alias("words"),
    )
    bigrams = F.concat(itself, F.coalesce(ngrams("words", 2), F.array_remove(itself, "")))
    numbers = (
        explode_array(words.withColumn("n_words", F.size("words")), [key, "row", "n_words"], bigrams, "bigram")
        .where((F.col("bigram") == "") | may_hold(some, F.col("bigram")))
        .join(noise, "bigram", "left_semi")
        .groupBy("row")
        .agg(
            F.max(key).alias(key),
            F.max("n_words").alias("n_words"),
            F.count_if(F.col("bigram") != "").alias("noise"),
            F.count_if(F.col("bigram") == "").alias("copies"),
        )
    )
    share = F.try_divide(F.col("noise") / F.col("copies"), "n_words")
    verdict = (F.col("n_words") >= min_words) & (share < noise_share)
    judged = numbers.select(key, F.coalesce(verdict, F.lit(False)).alias("is_substantive"), "copies")
    return repeated(judged, "copies")


# ---------------------------------------------------------------- sampling


def random_order(seed: int | str, key: str = "speech_id") -> Column:
    """A repeatable shuffle of the rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))


def quality_sample(
    speeches: DataFrame,
    seed: int | str = 0,
    batch: int = fv.QUALITY_BATCH,
    min_chars: int = fv.QUALITY_MIN_CHARS,
) -> DataFrame:
    """One speech worth reading: from a random batch of long speeches the first
    that opens without procedure, or the longest if none does."""
    drawn = (
        speeches.where(F.length("speech") > min_chars)
        .withColumn("draw", random_order(seed))
        .orderBy("draw", "speech_id")
        .limit(batch)
        .withColumn("passes", intro_substantive())
    )
    preference = [
        F.desc("passes"),
        F.when(~F.col("passes"), F.length("speech")).desc(),
        F.asc("draw"),
        F.asc("speech_id"),
    ]
    return drawn.orderBy(*preference).limit(1).drop("draw")
