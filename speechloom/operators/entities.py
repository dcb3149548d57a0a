"""Entities named in speeches, and which of them matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions.text import WORD, strip_space, word_tokens
from speechloom.plans.matching import term_spans


def tag_entities(speeches: DataFrame, gazetteer: DataFrame, key: str = "speech_id") -> DataFrame:
    """Entity spans (key, position, ent_text, label) of a (term, label)
    dictionary. Terms are cut into words as texts are, so that dots, hyphens and
    apostrophes part words in both; they may have any number of words, and
    overlapping spans are all reported."""
    words = F.regexp_extract_all("speech", F.lit(f"[{WORD}]+"), F.lit(0))
    texts = speeches.select(key, words.alias("words"))
    spans = term_spans(texts, [key], "words", gazetteer, word_tokens("term"))
    return spans.select(key, "position", F.col("span").alias("ent_text"), "label")


def judge_entities(
    entities: DataFrame,
    stop_terms: DataFrame,
    policy: DataFrame,
    labels: Sequence[str] = fv.STANDARD_ENTITY_LABELS,
) -> DataFrame:
    """Entities with their policy category, if any, and whether they are kept:
    no stop term, and a policy term or of a standard label. ``stop_terms`` has
    the column term, ``policy`` the columns term and category. A term names an entity
    as it stands and by its words; of two categories that it so gets, the first."""
    named = F.explode(F.array_distinct(F.array("term", F.array_join(word_tokens("term"), " ")))).alias("clean")
    stops = stop_terms.select(named).distinct().withColumn("stopped", F.lit(True))
    categories = policy.select(named, "category").groupBy("clean").agg(F.min("category").alias("category"))
    # one lookup for both lists: the entities are joined once
    lookup = stops.join(categories, "clean", "full")
    wanted = F.col("category").isNotNull() | F.col("label").isin(list(labels))
    return (
        entities.withColumn("clean", strip_space(F.lower("ent_text")))
        .join(lookup, "clean", "left")
        .withColumn("kept", F.col("stopped").isNull() & wanted)
        .drop("stopped")
    )


def denoise_entities(judged: DataFrame) -> DataFrame:
    """The entities worth keeping, as they were tagged."""
    return judged.where("kept").drop("clean", "category", "kept")


def entity_table(judged: DataFrame, key: str = "speech_id") -> DataFrame:
    """Kept entities with type and source, those of a speech together and its
    policy terms first. Here the text is compared as tagged: with space around
    it, it is not a policy term."""
    exact = F.col("category").isNotNull() & (F.lower("ent_text") == F.col("clean"))
    return (
        judged.where("kept")
        .select(
            key,
            "position",
            F.col("ent_text").alias("entity"),
            F.when(exact, F.col("category")).otherwise(F.col("label")).alias("type"),
            F.when(exact, fv.POLICY_SOURCE).otherwise(fv.MODEL_SOURCE).alias("source"),
        )
        .repartition(key)
        .sortWithinPartitions(key, F.desc("source"), "position", "entity")
    )


def entity_stats(judged: DataFrame, key: str = "speech_id") -> DataFrame:
    """Entities of each speech before and after denoising."""
    return judged.groupBy(key).agg(
        F.count("*").alias("n_entities"), F.count_if("kept").alias("n_kept")
    )
