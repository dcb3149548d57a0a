"""Finding the terms of a table in tokenised texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.plans.bitmap import hash_bits, may_hold
from speechloom.plans.joins import HOT_KEYS, HOT_SPREAD, fits_broadcast


def term_spans(
    texts: DataFrame, keep: Sequence[str], words: str, terms: DataFrame, term_words: Column
) -> DataFrame:
    """Every place where the words of a term stand: the ``keep`` columns,
    ``position`` (of the first word), ``span`` (the words as they stand) and the
    columns of ``terms``. Words are compared in lower case, terms may be of any
    length, and overlapping spans are all found.

    Terms are looked for at one of their words, the anchor. If they are few enough to
    be sent to the texts, it is their longest word; if not, it is the one that the
    texts use least, and only words that are an anchor move, with what stands around
    them. Which of the two is taken changes no row.
    """
    known = terms.columns
    listed = terms.withColumn("_words", term_words).where(F.size("_words") > 0)
    listed = listed.select(*known, "_words", F.array_join("_words", " ").alias("_whole"))
    texts = texts.select(*keep, F.col(words).alias("_text"))
    if fits_broadcast(terms):
        return _beside(texts, keep, listed, known)
    return _by_rarest(texts, keep, listed, known)


def _beside(texts: DataFrame, keep: Sequence[str], listed: DataFrame, known: Sequence[str]) -> DataFrame:
    longest = F.array_max(F.transform("_words", lambda w: F.length(w)))
    at = F.array_position(F.transform("_words", lambda w: F.length(w)), longest).cast("int") - 1
    listed = listed.withColumn("_at", at).select(
        *known, "_whole", "_at", F.get("_words", F.col("_at")).alias("_anchor"), F.size("_words").alias("_length")
    )
    places = texts.select(*keep, "_text", F.posexplode_outer("_text").alias("_place", "_word"))
    begin = F.col("_place") - F.col("_at")
    # A term that would begin before the text has no words there.
    span = F.when(begin >= 0, F.array_join(F.slice("_text", F.greatest(begin, F.lit(0)) + 1, F.col("_length")), " "))
    found = (F.lower("_word") == F.col("_anchor")) & (F.lower(span) == F.col("_whole"))
    return places.join(F.broadcast(listed), found).select(
        *keep, begin.alias("position"), span.alias("span"), *known
    )


def _by_rarest(texts: DataFrame, keep: Sequence[str], listed: DataFrame, known: Sequence[str]) -> DataFrame:
    # How often the texts use the words of the terms.
    own = listed.select("_whole", F.posexplode("_words").alias("_at", "_anchor")).distinct()
    some = hash_bits(own, "_anchor")
    used = (
        texts.select(F.explode("_text").alias("_word"))
        .select(F.lower("_word").alias("_anchor"))
        .where(may_hold(some, F.col("_anchor")))
        .groupBy("_anchor")
        .agg(F.count("*").alias("_n"))
    )
    # A term with a word that no text uses is found nowhere.
    chosen = (
        own.join(used, "_anchor", "left")
        .groupBy("_whole")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_at", "_anchor")).alias("_best"))
        .where(F.col("_best._n") > 0)
        .select("_whole", "_best.*")
    )
    # Rows of a heavy anchor are dealt over places, and its terms copied to each.
    weights = chosen.groupBy("_anchor").agg(F.max("_n").alias("_n"))
    all_rows = weights.agg(F.sum("_n")).scalar()
    heavy = weights.orderBy(F.desc("_n"), "_anchor").limit(HOT_KEYS).select(
        "_anchor", F.ceil(F.col("_n") * HOT_SPREAD / all_rows).cast("int").alias("_dealt")
    )
    listed = (
        listed.select(*known, "_whole", F.size("_words").alias("_length"))
        .join(chosen.drop("_n"), "_whole")
        .join(F.broadcast(heavy), "_anchor", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_dealt", F.lit(1)) - 1)))
        .drop("_dealt")
    )
    # Around an anchor, as many words as any term has before and after its own.
    before = listed.agg(F.max("_at")).scalar()
    after = listed.agg(F.max(F.col("_length") - F.col("_at"))).scalar()
    some = hash_bits(chosen, "_anchor")
    first = F.greatest(F.col("_place") - before, F.lit(0))
    places = (
        texts.select(*keep, "_text", F.posexplode("_text").alias("_place", "_word"))
        .where(may_hold(some, F.lower("_word")))
        .select(
            *keep,
            "_place",
            first.alias("_first"),
            F.lower("_word").alias("_anchor"),
            F.slice("_text", first + 1, F.col("_place") - first + after).alias("_window"),
        )
        .join(F.broadcast(heavy), "_anchor", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*keep, "_place"), F.coalesce("_dealt", F.lit(1))).cast("int"))
    )
    begin = F.col("_place") - F.col("_at")
    inside = F.slice("_window", F.greatest(begin - F.col("_first"), F.lit(0)) + 1, F.col("_length"))
    span = F.when(begin >= 0, F.array_join(inside, " "))
    return (
        places.join(listed, ["_anchor", "_salt"])
        .where(F.lower(span) == F.col("_whole"))
        .select(*keep, begin.alias("position"), span.alias("span"), *known)
    )
