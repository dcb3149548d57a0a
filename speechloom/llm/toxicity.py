"""Toxicity by a counterfactual-regularised classifier.

Logistic regression on the words a text holds and on their beginnings. Terms that
name a group of people must not decide: each labelled text with such terms is made
twice more, once with the next terms of their kinds and once without any, and the
squared differences of the scores (before the logistic) are penalised, as their mean
over all these texts. So neither which group is named nor that one is named moves a
score by itself.

The fit takes a bounded number of labelled texts; the hashed words keep each of
them bounded, too. Scoring reads every text where it is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.columns import portions
from speechloom.llm.training import labelled_sample, remainder

WORDS = re.compile(r"\w+")
# Beginnings of words that are features besides the words; all are hashed to
# so many numbers.
STEMS = (4, 5, 6)
FEATURES = 1 << 20
# Labelled texts of either label that the classifier is fitted on, and features it uses.
PER_CLASS = 3000
SELECTED = 2000
# A feature must occur in so many labelled texts, and this unevenly (chi square).
LEAST_TEXTS, LEAST_CHI = 5, 15.0
RIDGE = 1e-4
# Weight of the mean squared difference to the swapped texts.
COUNTERFACTUAL = 10.0
ROUNDS = 400
HELD_OUT_PARTS, HELD_OUT = 5, 0
THRESHOLD = 0.5

# Terms of a kind, each exchanged for the next.
IDENTITY = {
    "gender": "man woman men women male female boy girl boys girls nonbinary",
    "religion": "christian muslim jewish hindu buddhist sikh atheist catholic protestant",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer",
    "gender identity": "transgender cisgender trans cis",
    "origin": "african american asian european arab latino mexican chinese indian turkish",
    "colour": "black white brown",
    "age": "young old teenage elderly",
    "ability": "blind deaf disabled autistic",
}


def _features(words: set[str]) -> set[int]:
    """Hashes of words and of their beginnings, which endings leave alone."""
    names = {f"{size} {word[:size]}" for size in STEMS for word in words if len(word) > size}
    return {zlib.crc32(name.encode()) % FEATURES for name in words | names}


def features(text: str | None) -> set[int]:
    """What a text holds, however often."""
    return _features(set(WORDS.findall((text or "").lower())))


NEXT = {
    a: b for terms in map(str.split, IDENTITY.values()) for a, b in zip(terms, [*terms[1:], terms[0]])
}


def swapped(words: set[str]) -> list[set[str]]:
    """The words with the next identity terms of their kinds, and without any; none
    for words without identity terms."""
    if NEXT.keys().isdisjoint(words):
        return []
    return [{NEXT.get(w, w) for w in words}, words - NEXT.keys()]


def changes(text: str | None) -> list[tuple[list[int], list[int]]]:
    """The features that each swapped text has and the text itself has not, and those
    that it has not any more."""
    words = set(WORDS.findall((text or "").lower()))
    own = _features(words)
    made = [_features(other) for other in swapped(words)]
    return [(sorted(f - own), sorted(own - f)) for f in made]


@dataclass(frozen=True)
class Classifier:
    bias: float
    weights: dict[int, float]

    def score(self, text: str | None) -> float:
        # In a fixed order, so that reruns agree to the last digit.
        z = self.bias + sum(self.weights[x] for x in sorted(features(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _selected(texts: list[np.ndarray], y: np.ndarray) -> list[int]:
    """The features that tell the labels apart best (by chi square), and those
    of identity terms."""
    flat = np.concatenate(texts)
    owner = np.repeat(y, [len(x) for x in texts])
    ids, at = np.unique(flat, return_inverse=True)
    ones = np.bincount(at, owner, len(ids))
    both = np.bincount(at, minlength=len(ids)).astype(float)
    n, n1 = len(y), y.sum()
    expected = both * n1 / max(n, 1)
    spread = both * (n1 / max(n, 1)) * (1 - n1 / max(n, 1)) * (1 - both / max(n, 1)) + 1e-9
    chi = np.where(both >= LEAST_TEXTS, (ones - expected) ** 2 / spread, -1)
    best = np.argsort(-chi, kind="stable")[:SELECTED]
    terms = {f for term in NEXT for f in _features({term})}
    return sorted({*ids[best[chi[best] > LEAST_CHI]].tolist(), *terms})


def fit(
    texts: list[np.ndarray],
    labels: list[int],
    share: float,
    changed: list[tuple[list[int], list[int]]] = (),
) -> Classifier:
    """Logistic regression on the texts' features; ``share`` is that of label 1
    among all labelled texts, to which the scores are calibrated. ``changed`` has the
    ``changes`` of all texts."""
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        # Nothing to tell apart: every text gets the share of label 1.
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Classifier(float(np.log(p / (1 - p))), {})
    chosen = _selected(texts, y)
    place = {f: k for k, f in enumerate(chosen)}
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for row, found in enumerate(texts):
        x[row, [place[f] for f in found.tolist() if f in place]] = 1
    # A row per kind of change, which weighs as many texts as have it. Terms that no
    # text has are once put into an empty text, so that they stay alike, too.
    kinds = Counter((tuple(gained), tuple(lost)) for gained, lost in changed)
    kinds.update((tuple(gained), tuple(lost)) for term in NEXT for gained, lost in changes(term))
    change, strength = np.zeros((len(kinds), len(chosen)), np.float32), np.empty(len(kinds))
    for row, ((gained, lost), count) in enumerate(sorted(kinds.items())):
        change[row, [place[f] for f in gained if f in place]] = 1
        change[row, [place[f] for f in lost if f in place]] = -1
        strength[row] = count
    strength /= strength.sum()
    # Both labels weigh the same; the bias is set right afterwards.
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, bias = np.zeros(len(chosen)), 0.0
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + bias, -50, 50)))
        error = weight * (p - y)
        grad = error.astype(np.float32) @ x + RIDGE * w
        grad += COUNTERFACTUAL * (strength * (change @ w)) @ change
        grad = np.append(grad, error.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        rate = 0.1 * (1 - step / (ROUNDS + 1))
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    p = min(max(share, 1e-6), 1 - 1e-6)
    bias += np.log(p / (1 - p))
    return Classifier(float(bias), {f: float(v) for f, v in zip(chosen, w) if v})


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    per_class: int = PER_CLASS,
) -> Classifier:
    """Fits on at most ``per_class`` labelled documents of either label."""
    rows = docs.select(
        F.col(f"`{id_column}`").alias("_tx_id"), F.col(f"`{text_column}`").cast("string").alias("_tx_text")
    )
    own = labels.select(
        F.col(f"`{id_column}`").alias("_tx_id"), F.col(f"`{label_column}`").alias("_tx_label")
    )
    found, share = labelled_sample(rows, own, "_tx_label", learn, per_class, "_tx_id")

    def run(batches):
        for batch in portions(batches):
            texts = batch.column("_tx_text").to_pylist()
            numbers = pa.list_(pa.int32())
            hashed = pa.array([sorted(features(text)) for text in texts], numbers)
            made = pa.array([changes(text) for text in texts], pa.list_(pa.list_(numbers)))
            yield pa.RecordBatch.from_arrays([hashed, batch.column("_tr_label"), made], ["x", "y", "changed"])

    known = found.mapInArrow(run, "x array<int>, y int, changed array<array<array<int>>>").toArrow()
    texts = [x.values.to_numpy() for x in known.column("x")]
    changed = [pair for made in known.column("changed").to_pylist() for pair in made]
    return fit(texts, known.column("y").to_pylist(), share, changed)


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    per_class: int = PER_CLASS,
) -> DataFrame:
    """One row per document: its id, ``held_out`` (its label was never learnt
    from), ``score`` and ``predicted``.

    A null, empty or blank text holds no word and gets the classifier's bias.
    A row without id is held out. Repeated rows are scored alike. Labels that
    are null or neither 0 nor 1, or belong to no document, teach nothing; without
    both labels every text gets the share of label 1 (one half if there is none).
    Other columns play no part. An empty table gives an empty table.
    """
    out = F.col("_tx_id")
    model = train(
        docs,
        labels,
        remainder(out, HELD_OUT_PARTS) != HELD_OUT,
        id_column,
        text_column,
        label_column,
        per_class,
    )
    rows = docs.select(
        F.col(f"`{id_column}`").alias("_tx_id"), F.col(f"`{text_column}`").cast("string").alias("_tx_text")
    )
    kind = rows.schema["_tx_id"].dataType.simpleString()

    def run(batches):
        for batch in portions(batches):
            score = [model.score(text) for text in batch.column("_tx_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_tx_id"), pa.array(score, pa.float64())], ["_tx_id", "score"]
            )

    return rows.mapInArrow(run, f"_tx_id {kind}, score double").select(
        out.alias(id_column),
        (remainder(out, HELD_OUT_PARTS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
