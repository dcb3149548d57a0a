"""Model-based labels for the speeches that the rules leave open."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions.text import counted, word_tokens
from speechloom.operators.denoise import keyword_purge, zero_shot_label
from speechloom.operators.updates import apply_labels
from speechloom.plans.exploding import explode_array
from speechloom.plans.joins import join_counted
from speechloom.plans.rows import repeated, row_digest
from speechloom.schema import SCORES

# texts -> [(top label, its score)]
Scorer = Callable[[Sequence[str]], Sequence[tuple[str, float]]]


def unlabelled(speeches: DataFrame) -> DataFrame:
    return speeches.where(F.col("is_procedure").isNull())


def score_batch(
    speeches: DataFrame, load_scorer: Callable[[], Scorer], batch_size: int = 1024
) -> DataFrame:
    """Scores (speech_id, top_label, score) of the unlabelled speeches by any
    two-label text model. Each worker process loads the model once and keeps it
    for its later tasks."""
    # A broadcast value is one object for all tasks of a process.
    kept = speeches.sparkSession.sparkContext.broadcast({})

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "scorer" not in kept.value:
            kept.value["scorer"] = load_scorer()
        scorer = kept.value["scorer"]
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                rows = frame.iloc[start : start + batch_size]
                labels, scores = zip(*scorer(rows["speech"].fillna("").tolist()))
                yield pd.DataFrame(
                    {"speech_id": rows["speech_id"].array, "top_label": labels, "score": scores}
                )

    return unlabelled(speeches).select("speech_id", "speech").mapInPandas(score, SCORES)


def phrase_scorer(
    phrases: Sequence[str] = fv.PURGE_PHRASES, weight: float = 1.5, bias: float = -1.0
) -> Callable[[], Scorer]:
    """A stand-in model: logistic in the number of procedural phrases used."""
    # local names only, so that a worker needs no import of this package
    exp, procedure, debate, phrases = math.exp, fv.PROCEDURE_LABEL, fv.DEBATE_LABEL, list(phrases)

    def score_one(text: str) -> tuple[str, float]:
        lowered = text.lower()
        z = bias + weight * sum(p in lowered for p in phrases)
        p = 1 / (1 + exp(-z))
        return (procedure, p) if p > 0.5 else (debate, 1 - p)

    return lambda: lambda texts: [score_one(t) for t in texts]


def phrase_scores(
    speeches: DataFrame,
    phrases: Sequence[str] = fv.PURGE_PHRASES,
    weight: float = 1.5,
    bias: float = -1.0,
) -> DataFrame:
    """What :func:`score_batch` gives with :func:`phrase_scorer`, as expressions."""
    # Made by an explode of one, so that a text is looked through once.
    used = sum((F.contains("lowered", F.lit(p)).cast("int") for p in phrases), F.lit(0))
    chance = 1 / (1 + F.exp(-(F.lit(bias) + F.lit(weight) * used)))
    lowered = F.lower(F.coalesce("speech", F.lit(""))).alias("lowered")
    scored = unlabelled(speeches).select("speech_id", lowered)
    scored = scored.select("speech_id", F.explode(F.array(chance)).alias("chance"))
    likely = F.col("chance") > 0.5
    return scored.select(
        "speech_id",
        F.when(likely, fv.PROCEDURE_LABEL).otherwise(fv.DEBATE_LABEL).alias("top_label"),
        F.when(likely, F.col("chance")).otherwise(1 - F.col("chance")).alias("score"),
    )


def label_speeches(
    speeches: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    phrases: Sequence[str] = fv.PURGE_PHRASES,
    threshold: float = fv.CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """The whole labelling job: rules first, then a model for what they leave
    open. ``score`` gives (speech_id, top_label, score) of the speeches it is
    handed without label. What has a label keeps it, also if another row with the
    same id has none; open rows with the same id get the larger of their labels."""
    purged = keyword_purge(speeches, phrases)
    labels = score(purged).select(
        "speech_id", zero_shot_label(threshold=threshold).alias("is_procedure")
    )
    return apply_labels(purged, labels, open_only=True)


# --------------------------------------------------------- a model of counts


def _terms(speech: str, stop_words: Sequence[str]) -> Column:
    """What a text is judged by: each of its words, with how often it stands there.
    The empty term, once, stands for the text itself."""
    stops = sorted(set(stop_words))
    words = word_tokens(speech, 2)
    words = F.filter(words, lambda w: ~w.isin(stops)) if stops else words
    itself = F.array(F.struct(F.lit("").alias("term"), F.lit(1).alias("tf")))
    return F.concat(itself, F.coalesce(counted(words), F.array_remove(itself, itself[0])))


def train_classifier(labelled: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """A multinomial model of the labels in ``is_procedure``: the ``weight`` of each
    ``term``, which is the logarithm of how much likelier label 1 makes it than label
    0, and ``n``, how often it was seen. Counts are raised by one; the empty term has
    the weight of the labels themselves.

    One pass counts the words of each text in its row and adds them up by term;
    nothing is iterated. Texts that are NULL teach nothing, and without any labelled
    text all weights are 0.
    """
    rows = labelled.where(F.col("is_procedure").isin(0, 1) & F.col("speech").isNotNull())
    found = (
        explode_array(rows, ["is_procedure"], _terms("speech", stop_words), "pair")
        .groupBy(F.col("pair.term").alias("term"))
        .agg(*[F.sum(F.when(F.col("is_procedure") == k, F.col("pair.tf"))).alias(f"n{k}") for k in (0, 1)])
    )
    none = labelled.sparkSession.range(0, 1, 1, 1).select(
        F.lit("").alias("term"), *[F.lit(0).cast("long").alias(f"n{k}") for k in (0, 1)]
    )
    counts = found.unionByName(none).groupBy("term").agg(
        *[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in (0, 1)]
    )
    word = F.col("term") != ""
    totals = counts.agg(
        *[F.coalesce(F.sum(F.when(word, F.col(f"n{k}"))), F.lit(0)).alias(f"all{k}") for k in (0, 1)],
        F.count_if(word).alias("kinds"),
    )
    # One row, put into the expressions as a value.
    known = totals.select(F.struct("all0", "all1", "kinds")).scalar()
    counts = counts.withColumn("all", known)
    seen = F.log((F.col("n1") + 1.0) / (F.col("n0") + 1.0))
    size = F.log((F.col("all.all1") + F.col("all.kinds")) / (F.col("all.all0") + F.col("all.kinds")))
    return counts.select(
        "term", F.when(word, seen - size).otherwise(seen).alias("weight"), (F.col("n0") + F.col("n1")).alias("n")
    )


def classify(speeches: DataFrame, model: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """Scores and labels of the unlabelled speeches by a model of
    :func:`train_classifier` and its stop words: a row for each of them, whatever its
    id. Words that the model has not seen are passed over."""
    rows = unlabelled(speeches).select("speech_id", row_digest("speech_id", "speech").alias("row"), "speech")
    terms = explode_array(rows, ["speech_id", "row"], _terms("speech", stop_words), "pair").select(
        "speech_id", "row", "pair.term", "pair.tf"
    )
    # Equal rows are added up together: the sum is that of one times their number.
    scored = (
        join_counted(terms, model, ["term"], "n", "row")
        .groupBy("row")
        .agg(
            F.max("speech_id").alias("speech_id"),
            F.sum(F.col("tf") * F.col("weight")).alias("sum"),
            F.count_if(F.col("term") == "").alias("copies"),
        )
        .withColumn("chance", 1 / (1 + F.exp(-F.col("sum") / F.col("copies"))))
    )
    likely = F.col("chance") > 0.5
    return repeated(
        scored.select(
            "speech_id",
            F.when(likely, fv.PROCEDURE_LABEL).otherwise(fv.DEBATE_LABEL).alias("top_label"),
            F.round(F.greatest("chance", 1 - F.col("chance")), 6).alias("score"),
            "copies",
        ),
        "copies",
    ).withColumn("is_procedure", zero_shot_label())
