"""Document quality by Bradley-Terry pairwise ranking.

A preference pair is a labelled good document and a labelled bad one. The chance
that the first is preferred is the logistic of the difference of their scores; a
score is a weighted sum of measures of the text, so the weights come from
logistic regression on differences of measures. The score that as many of the
labelled documents exceed as are good is the threshold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.columns import cut, portions
from speechloom.llm.quality_rules import MEASURES, measure
from speechloom.llm.training import labelled_ids, remainder

# Pairs per labelled document; documents of a group that pairs are made in, and how
# many of either label it should have; bins in which worths are counted.
PAIRS = 10
GROUP, LEAST = 8192, 64
BINS = 1024
RIDGE = 1e-2
HELD_OUT_PARTS, HELD_OUT = 4, 2
THRESHOLD = 0.7
DIGIT = re.compile(r"\d")
ORDINARY = re.compile(r"\b[^\W\d_]{1,3}\b")
NAMES = list(MEASURES)


def measures(text: str | None) -> list[float]:
    """Measures of a whole text that do not depend on its language: its length,
    and shares between 0 and 1 of its words, lines and letters."""
    m = dict(zip(NAMES, measure(text)))
    text = text or ""
    words = text.split()
    n, lines, letters = max(1, m["n_words"]), max(1, m["n_lines"]), max(1, m["n_letters"])
    shares = [
        m["n_symbols"] / n,
        m["n_dup_lines"] / lines,
        m["n_repeat_words"] / n,
        m["n_capitals"] / letters,
        m["n_bare_words"] / n,
        m["n_glued_words"] / n,
        1 - m["n_ended_lines"] / lines,
        1 - len(set(words)) / n,
        len(ORDINARY.findall(text)) / n,
        len(DIGIT.findall(text)) / n,
        text.count("!") / n,
    ]
    length = np.log1p(m["n_words"])
    # Square roots spread out the small shares, which matter most.
    return [length, max(0.0, 3 - length), m["word_chars"] / n / 10, *np.sqrt(np.minimum(shares, 4))]


@dataclass(frozen=True)
class Ranking:
    """Document scores are ``weights`` times the standardised measures; at
    ``middle`` the threshold is reached."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    middle: float

    def worth(self, rows: np.ndarray) -> np.ndarray:
        return _worth(rows, np.array(self.mean), np.array(self.scale), np.array(self.weights))

    def score(self, rows: np.ndarray) -> np.ndarray:
        at_threshold = np.log(THRESHOLD / (1 - THRESHOLD))
        z = np.clip(self.worth(rows) - self.middle + at_threshold, -30, 30)
        return 1 / (1 + np.exp(-z))


def _learnt(measured: DataFrame, known: DataFrame) -> DataFrame:
    """The labelled measures (x, y), equal ones as one row with their number n."""
    rows = measured.join(known, "_bt_id").select("x", F.col("_tr_label").alias("y"))
    return cut(rows.groupBy("x", "y").agg(F.count("*").alias("n")))


def _groups(learnt: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """All learnt rows in groups of about ``GROUP``, one row each, within which pairs
    are made. A label too rare for all groups to have ``LEAST`` of it is copied to as
    many as that takes."""
    groups = -(-sum(sizes.values()) // GROUP)
    copies = {y: min(groups, -(-LEAST * groups // n)) for y, n in sizes.items()}
    first = F.pmod(F.xxhash64("x", "y"), F.lit(groups))
    number = F.when(F.col("y") == 1, copies[1]).otherwise(copies[0])
    placed = learnt.withColumn("copy", F.explode(F.sequence(F.lit(0), number - 1)))
    placed = placed.select("x", "y", "n", F.pmod(first + F.col("copy"), F.lit(groups)).alias("place"))

    def one_row(table: pa.Table) -> pa.Table:
        y, n = (table.column(c).to_numpy() for c in ("y", "n"))
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        order = np.lexsort([*x.T, y])
        whole = {"place": table.column("place")[:1], "x": [x[order].ravel()], "y": [y[order]], "n": [n[order]]}
        return pa.table(whole, pa.schema({"place": pa.int64(), "x": pa.list_(pa.float64()), "y": pa.list_(pa.int64()), "n": pa.list_(pa.int64())}))

    kind = "place long, x array<double>, y array<long>, n array<long>"
    return cut(placed.withColumn("y", F.col("y").cast("long")).groupBy("place").applyInArrow(one_row, kind))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z**2], 1)


def _worth(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    # Rounded, as the last digits depend on where in its batch a row stands.
    return np.round(_standard(x, mean, scale) @ w, 9)


def _pairs(z: np.ndarray, y: np.ndarray, n: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences of preference pairs and their weights: every document is paired
    with ``PAIRS`` of the other label, and both labels weigh the same."""
    random = np.random.default_rng(seed)
    sides = [np.flatnonzero(y == label) for label in (0, 1)]
    if not len(sides[0]) or not len(sides[1]):
        return np.zeros((0, z.shape[1])), np.zeros(0)
    differences, weights = [], []
    for own, other, sign in ((*sides, 1), (*sides[::-1], -1)):
        a = np.repeat(own, PAIRS)
        b = random.choice(other, size=len(a), p=n[other] / n[other].sum())
        differences.append(sign * (z[b] - z[a]))
        weights.append(n[a] / n[a].sum() * n.sum() / 2)
    return np.concatenate(differences), np.concatenate(weights)


def _slope(groups: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean log likelihood of all pairs. Each task sums
    up those of its groups; a row of fixed size per task goes to the driver."""
    width = len(w)

    def run(batches):
        total = np.zeros(width * width + width + 1)
        for batch in batches:
            for place, x, y, n in zip(*(batch.column(c) for c in ("place", "x", "y", "n"))):
                y, n = y.values.to_numpy(), n.values.to_numpy()
                z = _standard(x.values.to_numpy().reshape(len(y), -1), mean, scale)
                d, weight = _pairs(z, y, n, 7 + place.as_py())
                p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                curve = (d * (weight * p * (1 - p))[:, None]).T @ d
                total += np.concatenate([d.T @ (weight * (1 - p)), curve.ravel(), [weight.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    parts = [r["sums"] for r in groups.mapInArrow(run, "sums array<double>").collect()]
    total = np.sum(np.array(parts, float), 0)
    return total[:width] / total[-1], total[width:-1].reshape(width, width) / total[-1]


def _middle(ranked: DataFrame, share: float, sizes: dict[int, int]) -> float:
    """The worth that ``share`` of the labelled documents exceed, between two of them,
    or that of all of them where several are worth the same.
    Rows are counted in ``BINS`` bins of equal width, then those of one bin again, until
    it has a single worth."""

    def weight(ones: int, zeros: int) -> float:
        # Labelled rows may hold the labels in other shares than the labels do.
        return share * ones / sizes[1] + (1 - share) * zeros / sizes[0]

    low, high = ranked.agg(F.min("worth"), F.max("worth")).first()
    ones = zeros = 0
    own = None
    while low < high or own is None:
        inside = ranked.where((F.col("worth") >= low) & (F.col("worth") <= high))
        place = F.least(F.floor((F.col("worth") - low) / ((high - low) or 1.0) * BINS), F.lit(BINS - 1))
        one = F.when(F.col("y") == 1, F.col("n")).otherwise(0)
        counted = inside.groupBy(place.alias("bin")).agg(
            F.sum(one).alias("ones"),
            F.sum(F.col("n") - one).alias("zeros"),
            F.min("worth").alias("low"),
            F.max("worth").alias("high"),
        )
        bins = sorted(counted.collect(), key=lambda r: r["bin"])
        for r in bins:
            if r is bins[-1] or weight(ones + r["ones"], zeros + r["zeros"]) >= 1 - share - 1e-12:
                break
            ones, zeros = ones + r["ones"], zeros + r["zeros"]
        low, high, own = r["low"], r["high"], r
    last = weight(1, 0) if own["ones"] else weight(0, 1)
    if weight(ones + own["ones"], zeros + own["zeros"]) - last >= 1 - share - 1e-12:
        return low
    after = ranked.where(F.col("worth") > low).agg(F.min("worth")).first()[0]
    return (low + (low if after is None else after)) / 2


def measured(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Ids and measures of all texts, written once: they are learnt from, then scored."""
    rows = docs.select(
        F.col(f"`{id_column}`").alias("_bt_id"), F.col(f"`{text_column}`").cast("string").alias("_bt_text")
    )
    kind = rows.schema["_bt_id"].dataType.simpleString()

    def run(batches):
        for batch in portions(batches):
            found = [measures(text) for text in batch.column("_bt_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_bt_id"), pa.array(found, pa.list_(pa.float64()))], ["_bt_id", "x"]
            )

    return cut(rows.mapInArrow(run, f"_bt_id {kind}, x array<double>"))


def train(
    rows: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    label_column: str = "quality",
) -> Ranking:
    """Fits on all rows of ``measured`` that have a label to learn from: their mean and
    spread, weights by Newton's method on preference pairs, and the threshold are all
    computed where the rows are."""
    own = labels.select(
        F.col(f"`{id_column}`").alias("_bt_id"), F.col(f"`{label_column}`").alias("_bt_label")
    )
    known, share = labelled_ids(own, "_bt_label", learn, "_bt_id")
    learnt = _learnt(rows, known)
    found = {r["y"]: (r["rows"], r["n"]) for r in learnt.groupBy("y").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    width = len(measures(""))
    if len(found) < 2:
        # No pair: every document is worth the same.
        p = min(max(share, 1e-6), 1 - 1e-6)
        middle = np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(p / (1 - p))
        return Ranking((0.0,) * width, (1.0,) * width, (0.0,) * (2 * width), float(middle))
    total = sum(n for _, n in found.values())
    each = [F.get("x", F.lit(k)) for k in range(width)]
    # Sums of floats depend on their order in the last digits, which are dropped.
    mean = np.round([*learnt.agg(*[F.sum(F.col("n") * x) / total for x in each]).first()], 9)
    spread = [F.sum(F.col("n") * (x - F.lit(float(m))) ** 2) / total for x, m in zip(each, mean)]
    scale = np.round(np.sqrt([*learnt.agg(*spread).first()]), 9)
    scale = np.where(scale > 1e-8, scale, 1.0)
    groups = _groups(learnt, {y: n for y, (n, _) in found.items()})
    w = np.zeros(2 * width)
    for _ in range(50):
        grad, curve = _slope(groups, mean, scale, w)
        step = np.linalg.solve(curve + RIDGE * np.eye(len(w)), grad - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    w = np.round(w, 9)

    def run(batches):
        for batch in batches:
            x = batch.column("x")
            worth = _worth(x.flatten().to_numpy().reshape(len(x), -1), mean, scale, w)
            yield pa.RecordBatch.from_arrays([pa.array(worth), batch.column("y"), batch.column("n")], ["worth", "y", "n"])

    ranked = cut(learnt.mapInArrow(run, "worth double, y int, n long"))
    middle = _middle(ranked, share, {y: n for y, (_, n) in found.items()})
    return Ranking(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), float(middle))


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
) -> DataFrame:
    """One row per document: its id, ``held_out`` (its label was never learnt
    from), ``score`` and ``predicted`` (the score reaches the threshold).

    Null, empty and blank texts are scored by their measures, which are those of
    a text without words. A row without id is never held out nor learnt from.
    Repeated rows are scored alike. Labels that are null or neither 0 nor 1, or
    belong to no document, teach nothing; without both labels every text gets the
    share of label 1 (one half if there is none). Other columns play no part. An
    empty table gives an empty table.
    """
    out = F.col("_bt_id")
    held_out = remainder(out, HELD_OUT_PARTS) == HELD_OUT
    rows = measured(docs, id_column, text_column)
    model = train(rows, labels, ~held_out, id_column, label_column)
    kind = rows.schema["_bt_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = batch.column("x")
            found = x.flatten().to_numpy().reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_bt_id"), pa.array(model.score(found), pa.float64())],
                ["_bt_id", "score"],
            )

    return rows.mapInArrow(run, f"_bt_id {kind}, score double").select(
        out.alias(id_column),
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
