"""Denoising rules, labels, updates."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.operators import classify, denoise, updates

SPEECH = "speech_id string, speech string, is_procedure int"


@pytest.mark.parametrize(
    "text, old, new",
    [
        ("I ask, Mr. Speaker, to", None, 1),
        ("thank you MRS SPEAKER", None, 1),  # a dot in a phrase matches any character
        ("x" * (499 - 8) + "so order", None, None),
        ("so ordered" + "x" * 489, None, 1),
        ("so ordered" + "x" * 490, None, None),
        ("so ordered", 0, 0),
        ("so ordered", 1, 1),
        (None, None, None),
    ],
)
def test_purge(spark, text, old, new):
    row = denoise.keyword_purge(spark.createDataFrame([("1", text, old)], SPEECH)).first()
    assert row.is_procedure == new


@pytest.mark.parametrize(
    "label, score, want",
    [
        (fv.PROCEDURE_LABEL, 0.70, 0),
        (fv.PROCEDURE_LABEL, 0.7000001, 1),
        (fv.DEBATE_LABEL, 0.99, 0),
    ],
)
def test_zero_shot(spark, label, score, want):
    df = spark.createDataFrame([(label, score)], "top_label string, score double")
    assert df.select(denoise.zero_shot_label()).first()[0] == want


PAD = "x" * 600


@pytest.mark.parametrize(
    "text, want",
    [
        ("y" * 139 + "quorum call" + PAD, False),
        ("y" * 140 + "quorum call" + PAD, True),
        ("y" * 138 + " Quorum Call" + PAD, False),
        ("y" * 139 + " Quorum Call" + PAD, True),
        (" \xa0\n" + "y" * 139 + "quorum call" + PAD, False),
        ("y" * 151 + "quorum call" + PAD, True),
        ("y" * 499, False),
        ("y" * 500, True),
    ],
)
def test_intro_rule(evaluate, text, want):
    assert evaluate(denoise.intro_substantive("x"), text) is want
    plain = text.lower().strip()[:150]
    assert want == (len(text) >= 500 and not any(p in plain for p in fv.INTRO_PHRASES))


NOISE = ["the the", "of the"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a b c d e f g h i", False),
        ("a b c d e f g h i j", True),
        ("the the the the e f g h i j", False),  # 3 of 10 words is not under the share
        ("The  THE the d e f g h i j", True),  # 2 of 10
        ("", False),
        (None, False),
    ],
)
def test_bigram_rule_all_ways(spark, evaluate, without_broadcasts, text, want):
    assert evaluate(denoise.bigram_substantive(NOISE, "x"), text) is want
    df = spark.createDataFrame([("1", text)], "speech_id string, speech string")
    noise = spark.createDataFrame([(b,) for b in NOISE * 2], "bigram string")
    assert denoise.bigram_substantive_table(df, noise).collect() == [("1", want)]
    with without_broadcasts():
        assert denoise.bigram_substantive_table(df, noise).collect() == [("1", want)]


def test_bigram_table_judges_row_by_row(spark, without_broadcasts):
    """Rows that share an id, or have none, are judged by their own words."""
    good, bad = "a b c d e f g h i j", "the the the the e f g h i j"
    rows = [("1", good), ("1", bad), (None, good), (None, bad), (None, None), ("2", "short")]
    df = spark.createDataFrame(rows, "speech_id string, speech string")
    noise = spark.createDataFrame([(b,) for b in NOISE], "bigram string")
    want = sorted([("1", True), ("1", False), (None, True), (None, False), (None, False), ("2", False)], key=str)
    listed = df.select("speech_id", denoise.bigram_substantive(NOISE).alias("ok"))
    assert sorted(map(tuple, listed.collect()), key=str) == want
    assert sorted(map(tuple, denoise.bigram_substantive_table(df, noise).collect()), key=str) == want
    with without_broadcasts():
        got = denoise.bigram_substantive_table(df, noise).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_progress_of_nothing(spark):
    row = denoise.label_progress(spark.createDataFrame([], SPEECH)).first()
    assert (row.total, row.done, row.percent, row.minutes_left) == (0, 0, None, 0.0)


def test_quality_sample_falls_back_to_the_longest(spark):
    rows = [(str(i), "quorum call " + "x" * (1000 + i), None) for i in range(5)]
    df = spark.createDataFrame(rows, SPEECH)
    assert denoise.quality_sample(df, seed=1).first().speech_id == "4"
    better = df.union(spark.createDataFrame([("9", "y" * 1001, None)], SPEECH))
    assert denoise.quality_sample(better, seed=1).first().speech_id == "9"


def test_upsert_resets_labels_and_is_idempotent(spark):
    current = spark.createDataFrame([("1", "a", 0), ("2", "b", 1)], SPEECH)
    new = spark.createDataFrame(
        [("1", "old", 1), ("1", "new", 2), ("3", "c", 1)], "speech_id string, speech string, seq int"
    )
    once = updates.upsert_speeches(current, new, ["seq"])
    want = [("1", "new", None), ("2", "b", 1), ("3", "c", None)]
    assert sorted(map(tuple, once.collect())) == want
    twice = updates.upsert_speeches(once, new, ["seq"])
    assert sorted(map(tuple, twice.collect())) == want
    kept = updates.upsert_speeches(current, new, ["seq"], keep_labels=True)
    assert sorted(map(tuple, kept.select("speech_id", "speech", "is_procedure").collect()))[0] == ("1", "new", 0)


def test_upsert_of_one_hot_key(spark):
    current = spark.createDataFrame([("1", "a", 0)], SPEECH)
    new = spark.range(5000).select(
        F.when(F.col("id") >= 0, "1").alias("speech_id"), F.col("id").cast("string").alias("speech"), F.col("id").alias("seq")
    )
    result = updates.upsert_speeches(current, new, ["seq"])
    assert [tuple(r) for r in result.collect()] == [("1", "4999", None)]
    # a task's share of a key is cut to one row before the shuffle
    assert "WindowGroupLimit" in result._jdf.queryExecution().executedPlan().toString()


def test_apply_labels_never_multiplies_rows(spark):
    speeches = spark.createDataFrame([("1", "a", 0), ("2", "b", None)], SPEECH)
    labels = spark.createDataFrame([("1", 1), ("1", 1)], "speech_id string, is_procedure int")
    rows = sorted(map(tuple, updates.apply_labels(speeches, labels).collect()))
    assert rows == [("1", "a", 1), ("2", "b", None)]


def test_unprocessed(spark):
    packages = spark.createDataFrame([("a",), ("b",), ("b",)], "package_id string")
    done = spark.createDataFrame([("a",)], "package_id string")
    assert [r[0] for r in updates.unprocessed(packages, done).collect()] == ["b"]


def test_score_batch_scores_open_speeches_only(spark):
    df = spark.createDataFrame(
        [("1", "so ordered, unanimous consent", None), ("2", None, None), ("3", "x", 0)], SPEECH
    )
    rows = {r.speech_id: r for r in classify.score_batch(df, classify.phrase_scorer(), 1).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].top_label == fv.PROCEDURE_LABEL and rows["2"].top_label == fv.DEBATE_LABEL


def test_scores_as_expressions_are_those_of_the_scorer(spark):
    rows = [("1", "So ordered, Unanimous Consent", None), ("2", None, None), ("3", "x", 0), ("4", "yield", None)]
    df = spark.createDataFrame(rows, SPEECH)
    scored = {r.speech_id: r for r in classify.phrase_scores(df).collect()}
    for r in classify.score_batch(df, classify.phrase_scorer()).collect():
        assert scored[r.speech_id].top_label == r.top_label
        assert scored[r.speech_id].score == pytest.approx(r.score, abs=1e-12)
    assert set(scored) == {"1", "2", "4"}


def test_a_worker_loads_its_model_once(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4()}"), "w").close()
        return lambda texts: [("x", 1.0) for _ in texts]

    df = spark.range(200).selectExpr(
        "cast(id as string) as speech_id", "'a' as speech", "cast(null as int) as is_procedure"
    )
    # more tasks than there are processes, if other tests left few of them idle
    assert len(classify.score_batch(df.repartition(200), load).collect()) == 200
    loads = [path.name.split("-")[0] for path in tmp_path.iterdir()]
    assert len(loads) == len(set(loads))


def test_classifier_learns_a_clear_rule(spark):
    rows = [(str(i), "yield back the floor" if i % 2 else "silver and gold coinage", i % 2) for i in range(40)]
    model = classify.train_classifier(spark.createDataFrame(rows, SPEECH))
    fresh = spark.createDataFrame([("a", "yield the floor", None), ("b", "gold", None)], SPEECH)
    labels = {r.speech_id: r.is_procedure for r in classify.classify(fresh, model).collect()}
    assert labels == {"a": 1, "b": 0}


def plain_model(rows, stops=()):
    """Scores of the open rows, word by word."""
    words = lambda t: [w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in stops]
    known = [(words(t), y) for _, t, y in rows if t is not None and y is not None]
    counts = [Counter(w for ws, y in known if y == k for w in ws) for k in (0, 1)]
    kinds = len(counts[0] | counts[1])
    size = [sum(c.values()) + kinds for c in counts]
    prior = math.log((sum(y for _, y in known) + 1) / (sum(1 - y for _, y in known) + 1))
    out = []
    for i, t, y in rows:
        if y is None:
            seen = [w for w in words(t) if w in counts[0] or w in counts[1]]
            z = prior + sum(math.log((counts[1][w] + 1) / (counts[0][w] + 1) * size[0] / size[1]) for w in seen)
            p = 1 / (1 + math.exp(-z))
            out.append((i, round(max(p, 1 - p), 6), int(p > 0.7)))
    return sorted(out, key=str)


def test_classifier_equals_a_plain_one(spark, without_broadcasts):
    rng = random.Random(7)
    words = ["the", "yield", "floor", "gold", "coin", "a", "stop", "bank"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
    rows = [(rng.choice(["1", "2", None, str(k)]), text(), rng.choice([0, 1, None])) for k in range(120)]
    # equal rows, rows of one id, texts that are NULL, words never seen, a hot word
    rows += [("7", "gold gold", None)] * 5 + [(None, None, None)] * 3 + [("8", None, 1), ("9", "unseen words", None)]
    rows += [("h", "the " * 500, k % 2) for k in range(9)] + [("h", "the " * 400, None)]
    df = spark.createDataFrame(rows, SPEECH)
    names = ["speech_id", "score", "is_procedure"]

    def got():
        model = classify.train_classifier(df, ["stop"])
        return sorted(map(tuple, classify.classify(df, model, ["stop"]).select(*names).collect()), key=str)

    assert got() == plain_model(rows, ["stop"])
    with without_broadcasts():
        assert got() == plain_model(rows, ["stop"])


def test_classifier_without_labels(spark):
    df = spark.createDataFrame([("1", "any words", None), (None, None, None)], SPEECH)
    scored = classify.classify(df, classify.train_classifier(df)).collect()
    assert sorted((r.speech_id, r.score, r.is_procedure) for r in scored if r.speech_id) == [("1", 0.5, 0)]
    assert len(scored) == 2
    none = df.limit(0)
    assert classify.classify(none, classify.train_classifier(none)).collect() == []


def test_repeated_rows(spark, monkeypatch):
    from speechloom.plans import rows as helper

    monkeypatch.setattr(helper, "REPEATS", 4)
    df = spark.createDataFrame([("a", 1), ("b", 4), ("c", 5), ("d", 13)], "x string, n long")
    assert Counter(r.x for r in helper.repeated(df, "n").collect()) == {"a": 1, "b": 4, "c": 5, "d": 13}


def test_what_has_a_label_keeps_it(spark):
    rows = [("1", "plain words", 1), ("1", "plain words", None), ("2", "so ordered", None), (None, "x", None)]
    df = spark.createDataFrame(rows, SPEECH)
    labelled = classify.label_speeches(df, classify.phrase_scores, ["never found"])
    assert sorted((str(r.speech_id), str(r.is_procedure)) for r in labelled.collect()) == [
        ("1", "0"), ("1", "1"), ("2", "0"), ("None", "None"),
    ]


def test_updates_without_id_are_all_added(spark):
    current = spark.createDataFrame([("1", "a", 0), (None, "mine", 1)], SPEECH)
    new = spark.createDataFrame(
        [(None, "x", 1), (None, "y", 2), (None, "y", 2), ("1", "b", 1)], "speech_id string, speech string, seq int"
    )
    got = updates.upsert_speeches(current, new, ["seq"], keep_labels=True)
    assert sorted(((r.speech_id, r.speech, r.is_procedure) for r in got.collect()), key=str) == sorted(
        [("1", "b", 0), (None, "mine", 1), (None, "x", None), (None, "y", None), (None, "y", None)], key=str
    )


def test_a_worker_needs_no_import_of_the_package(spark):
    import pickletools

    from pyspark import cloudpickle

    payload = cloudpickle.dumps(classify.phrase_scorer())
    imports, strings = set(), []
    for op, value, _ in pickletools.genops(payload):
        if op.name in ("SHORT_BINUNICODE", "BINUNICODE"):
            strings.append(value)
        elif op.name == "STACK_GLOBAL":
            imports.add(strings[-2])
    assert not any(name.startswith("speechloom") for name in imports)
