"""Quality rules by weak supervision.

Rules look at measures of a whole text and vote good, bad or abstain. No rule
decides: expectation-maximisation over the votes of all documents estimates how
often each rule is right, and a document's verdict is the probability that it is
good given its votes. Only two measures fail a document by themselves: too few
words, and too many words in repeated windows.

Votes are counted per pattern (at most three to the number of rules), so that
what the estimation gathers is bounded whatever the number of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.columns import batch_of, cut, portions, schema_of, without

MEASURES = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "n_lines": "long",
    "n_letters": "long",
    "n_capitals": "long",
    "n_bare_words": "long",
    "n_ended_lines": "long",
    "n_glued_words": "long",
}
VERDICT = ("base_failed", "votes", "probability", "kept")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"
SYMBOL = re.compile(SYMBOLS)
GLUED = re.compile(r"[^\W_][^\w\s]*[#*$%&|<>]{2}")
LETTERS = re.compile(r"[^\W\d_]+")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
ENDS = tuple(end.encode() for end in ".!?…:;\"'”’»)]")


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``; a null has none."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    # Bytes of words without those that continue a character.
    chars = sum(map(len, words)) - (len(data) - len(text))
    repeated = 0
    if n > WINDOW:
        seen: dict[tuple, int] = {}
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) < len(windows):
            for window in windows:
                seen[window] = seen.get(window, 0) + 1
            reach = 0
            for at, window in enumerate(windows):
                if seen[window] > 1:
                    repeated += at + WINDOW - max(reach, at)
                    reach = at + WINDOW
    lines = [line for line in data.split(b"\n") if line.split()]
    letters = sum(map(len, LETTERS.findall(text)))
    ended = sum(line.rstrip().endswith(ENDS) for line in lines)
    symbols = len(SYMBOL.findall(text))
    bare = sum(not LETTERS.search(word) for word in text.split()) if symbols else 0
    return (
        n,
        chars,
        symbols,
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        letters,
        len(CAPITALS.findall(text)),
        bare,
        ended,
        len(GLUED.findall(text)) if symbols else 0,
    )


def with_measures(
    docs: DataFrame, text_column: str = "text", keep_text: bool = True
) -> DataFrame:
    """The documents with the measures of their whole texts. Columns that have a
    measure's name are replaced."""
    docs = without(docs, [*MEASURES, "_qr_text"]).withColumn(
        "_qr_text", F.col(f"`{text_column}`").cast("string")
    )
    docs = docs if keep_text else without(docs, [text_column])
    columns = [c for c in docs.columns if c != "_qr_text"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in portions(batches):
            rows = [measure(text) for text in batch.column("_qr_text").to_pylist()]
            found = zip(*rows) if rows else [()] * len(MEASURES)
            added = {name: pa.array(x, pa.int64()) for name, x in zip(MEASURES, found)}
            yield from batch_of(pa.Table.from_batches([batch]).select(columns), added).to_batches()

    ddl = ", ".join(f"{name} {kind}" for name, kind in MEASURES.items())
    return docs.mapInArrow(run, schema_of(docs.select(columns), ddl))


@dataclass(frozen=True)
class Rule:
    """Votes good while ``part`` / ``whole`` is within ``good`` bounds, bad while
    it is beyond ``bad`` ones, and else abstains."""

    name: str
    part: str
    whole: str | None
    good: tuple[float, float]
    bad: tuple[float, float]

    def vote(self) -> Column:
        value = F.col(self.part).cast("double")
        if self.whole:
            value = F.when(F.col(self.whole) > 0, value / F.col(self.whole))
        return (
            F.when(value.isNull(), F.lit("-"))
            .when(value.between(*self.good), F.lit("g"))
            .when((value < self.bad[0]) | (value > self.bad[1]), F.lit("b"))
            .otherwise(F.lit("-"))
        )


INF = float("inf")
RULES = (
    Rule("length", "n_words", None, (50, INF), (-1, INF)),
    Rule("word_length", "word_chars", "n_words", (3, 9), (2, 14)),
    Rule("symbols", "n_symbols", "n_words", (0, 0.02), (-1, 0.1)),
    Rule("glued_words", "n_glued_words", "n_words", (0, 0.02), (-1, 0.1)),
    Rule("capitals", "n_capitals", "n_letters", (0, 0.15), (-1, 0.4)),
    Rule("bare_words", "n_bare_words", "n_words", (0, 0.05), (-1, 0.2)),
    Rule("line_copies", "n_dup_lines", "n_lines", (0, 0.1), (-1, 0.3)),
    Rule("repeats", "n_repeat_words", "n_words", (0, 0.05), (-1, 0.2)),
    Rule("line_ends", "n_ended_lines", "n_lines", (0.6, 1), (0.1, 2)),
)


def votes(rules=RULES) -> Column:
    """A letter per rule: g, b or - for good, bad or no vote."""
    return F.concat(*[rule.vote() for rule in rules])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


# Where estimation starts: how often a rule that votes says bad of good and of
# bad documents, and the share of good ones.
FALSE_ALARM, ALARM, GOOD_SHARE = 0.01, 0.25, 0.85


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and how often each rule, when it votes, says bad
    of a good document and of a bad one. An abstention says nothing."""

    prior: float
    false_alarm: tuple[float, ...]
    alarm: tuple[float, ...]

    def probability(self, pattern: str) -> float:
        odds = np.log(self.prior) - np.log1p(-self.prior)
        for vote, wrong, right in zip(pattern, self.false_alarm, self.alarm):
            if vote == "b":
                odds += np.log(wrong) - np.log(right)
            elif vote == "g":
                odds += np.log1p(-wrong) - np.log1p(-right)
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def fit(counts: dict[str, int], rules: int, rounds: int = 1000) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    It starts from rules that seldom call a good document bad and find a quarter of
    the bad ones. No rule is taken to speak against its meaning: where it says bad of
    good documents more often than of bad ones, it is taken to say nothing. The share
    of good documents is free. The starting rates count as much as ``weight``
    documents.
    """
    weight = 20.0
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    said_bad = np.array([[c == "b" for c in p] for p in patterns], float).reshape(-1, rules)
    voted = np.array([[c != "-" for c in p] for p in patterns], float).reshape(-1, rules)
    model = LabelModel(GOOD_SHARE, (FALSE_ALARM,) * rules, (ALARM,) * rules)
    for _ in range(rounds):
        p = np.array([model.probability(x) for x in patterns])
        good, bad = n * p, n * (1 - p)
        alarm = (bad @ said_bad + ALARM * weight) / (bad @ voted + weight)
        false_alarm = (good @ said_bad + FALSE_ALARM * weight) / (good @ voted + weight)
        false_alarm = np.minimum(false_alarm, alarm)
        prior = (good.sum() + weight / 2) / (n.sum() + weight)
        before = model
        model = LabelModel(float(prior), tuple(false_alarm.tolist()), tuple(alarm.tolist()))
        flat = [np.array([m.prior, *m.false_alarm, *m.alarm]) for m in (before, model)]
        if np.abs(flat[0] - flat[1]).max() < 1e-9:
            break
    return model


def judged(measured: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Adds ``base_failed``, ``votes``, ``probability`` and ``kept`` to documents
    with measures. The model is estimated over the same documents."""
    voted = without(measured, VERDICT).select(
        "*", base_failed().alias("base_failed"), votes(rules).alias("votes")
    )
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit(counts, len(rules))
    # At most three to the number of rules, whatever the number of documents.
    table = [(p, model.probability(p)) for p in sorted(counts)]
    by_pattern = measured.sparkSession.createDataFrame(table, "votes string, probability double")
    return voted.join(F.broadcast(by_pattern), "votes").select(
        *[F.col(f"`{c}`") for c in voted.columns],
        "probability",
        (~F.col("base_failed") & (F.col("probability") >= threshold)).alias("kept"),
    )


def assess(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: its id, measures and verdict, without the text.

    A null text has no words and fails; so do empty and blank ones. Ids may be
    null or repeat; equal texts get equal verdicts. Other columns play no part.
    An empty table gives an empty table.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").alias("_qr_id"), F.col(f"`{text_column}`").alias("_qr_body")
    )
    # Written once: the votes are counted first, then read again.
    measured = cut(with_measures(rows, "_qr_body", keep_text=False))
    return judged(measured).withColumnRenamed("_qr_id", id_column)


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that ``assess`` keeps, with their columns unchanged. Texts
    stay where they are: they are measured once to fit the model, once to use it."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_qr_row"))
    body = F.col("_qr_row").getField(text_column)
    measured = with_measures(own.withColumn("_qr_body", body), "_qr_body", keep_text=False)
    return judged(measured).where("kept").select("_qr_row.*")
