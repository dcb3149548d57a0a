import re

import pytest
from pyspark.sql import functions as F

from speechloom.functions.text import mentions, ngrams, runs, space_tokens, word_tokens
from speechloom.operators import corpus

SPEECH = (
    "speech_id string, date int, speaker string, party string, state_x string, speech string, "
    "congress_session int, is_procedure int"
)


def rows_of(*rows):
    return [
        (str(i), 18990101 + s, "S", party, "OH", text, s, label)
        for i, (party, text, s, label) in enumerate(rows)
    ]


@pytest.fixture
def speeches(spark):
    long = " one two three four five six seven eight nine ten"
    return spark.createDataFrame(
        rows_of(
            ("D", "Gold standard" + long, 45, 0),
            ("R", "a golden age, gold gold" + long, 45, 0),
            ("R", "gold" + long, 46, None),
            ("R", "gold" + long, 46, 1),
            ("Unknown", "gold" + long, 47, 0),
            ("D", "gold short", 48, 0),
            (None, "gold" + long, 49, 0),
            ("D", None, 45, 0),
        ),
        SPEECH,
    )


@pytest.mark.parametrize(
    "text, phrase, want",
    [
        ("The GOLD rush", "gold", True),
        ("ÉTAT", "état", False),  # only ASCII letters fold
        ("ÉTAT", "Éta", True),
        ("100% sure", "0%s", True),
        ("a.b", "a.b", True),
        ("axb", "a.b", False),
        ("axb", "a_b", True),
        ("a\nb", "a%b", True),
        ("back\\slash", "k\\s", True),
        ("x", "", True),
        ("Kelvin", "kelvin", False),
    ],
)
def test_mentions(evaluate, text, phrase, want):
    assert evaluate(mentions("x", phrase), text) is want


def test_tokens_as_python(evaluate):
    text = "  L'été, foo_bar 12x   don't  — ÀB\t"
    assert evaluate(space_tokens("x"), text) == text.split()
    assert evaluate(word_tokens("x"), text) == re.findall(r"\b\w+\b", text.lower())
    assert evaluate(word_tokens("x", 2), text) == re.findall(r"\b\w\w+\b", text.lower())


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    rows = df.select(ngrams("w", 2), ngrams("w", 3), runs("w", 3)).collect()
    assert [tuple(r) for r in rows] == [
        (["a b", "b c"], ["a b c"], ["a", "b", "c", "a b", "b c", "a b c"]),
        ([], [], ["a"]),
        ([], [], []),
    ]


def test_lookup_trims_the_id(speeches):
    assert corpus.speech_by_id(speeches, " 3 ").first().congress_session == 46


def test_trend_counts_speeches_and_hides_unlabelled(speeches):
    rows = [tuple(r) for r in corpus.phrase_trend(speeches, "gold").collect()]
    assert rows == [(1899, "D", "Democrat", 2), (1899, "R", "Republican", 1)]
    both = corpus.phrase_trend(speeches, "gold", debate_only=False)
    assert both.agg(F.sum("mention_count")).first()[0] == 5


def test_share(speeches):
    rows = {r.congress_session: r for r in corpus.partisan_share(speeches, "gold").collect()}
    assert set(rows) == {45, 48}
    assert rows[45].rep_share == 0.5 and rows[48].rep_share == 0.0
    assert all(r.D_count + r.R_count == r.total and 0 <= r.rep_share <= 1 for r in rows.values())


def test_pivot_keeps_sessions_of_other_parties(speeches):
    hits = corpus.substantive_hits(speeches, "GOLD", ["x y"])
    rows = {r.congress_session: r for r in corpus.session_party_pivot(hits).collect()}
    assert set(rows) == {45, 46, 47}  # 48 is too short, 49 has no party
    assert (rows[47].D, rows[47].R, rows[47].total, rows[47].rep_share) == (0, 0, 0, None)
    order = [r.congress_session for r in corpus.polarized_sessions(corpus.session_party_pivot(hits)).collect()]
    assert order == [46, 45, 47]
    assert [r[0] for r in corpus.available_sessions(hits).collect()] == [49, 47, 46, 45]


def test_compare_equals_single_pivots(speeches):
    both = corpus.compare_phrases(speeches, ["Gold", "golden"], ["x y"])
    for phrase in ("gold", "golden"):
        one = corpus.session_party_pivot(corpus.substantive_hits(speeches, phrase, ["x y"]))
        assert sorted(map(tuple, both.where(F.col("phrase") == phrase).drop("phrase").collect())) == sorted(
            map(tuple, one.collect())
        )


def test_gallery_counts_lower_case_uses(speeches):
    hits = corpus.substantive_hits(speeches, "gold", ["x y"])
    rows = [r for r in corpus.speech_gallery(hits, "Gold", session=45).collect()]
    assert [(r.speech_id, r.relevance, r["rank"]) for r in rows] == [("1", 3, 1), ("0", 0, 2)]
    assert rows[0].highlighted.startswith("a **GOLD**en age, **GOLD** **GOLD** one")
    assert "Gold standard" in rows[1].highlighted


def test_gallery_cuts_before_the_shuffle(speeches):
    plan = corpus.speech_gallery(speeches, "gold")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_gallery_ranks_without_texts(spark):
    text = "gold and silver " * 3
    rows = [("1", text, 45, "D"), ("1", text, 45, "D"), ("1", "gold", 45, "R"), (None, "gold", 45, "D"), (None, "gold gold", 46, "D"), ("2", "none", 46, "D")]
    rows += [(str(k), "gold", 47, "D") for k in range(20)]
    df = spark.createDataFrame(rows, "speech_id string, speech string, congress_session int, party string")
    gallery = corpus.speech_gallery(df, "gold", k=4)
    got = sorted(((r.congress_session, r["rank"], r.speech_id, r.relevance, r.highlighted.count("**GOLD**")) for r in gallery.collect()), key=str)
    assert [g for g in got if g[0] == 45] == [(45, 1, "1", 3, 3), (45, 2, "1", 3, 3), (45, 3, None, 1, 1), (45, 4, "1", 1, 1)]
    assert [g for g in got if g[0] == 46] == [(46, 1, None, 2, 2), (46, 2, "2", 0, 0)]
    assert [g[2] for g in got if g[0] == 47] == ["0", "1", "10", "11"]
    plan = gallery._jdf.queryExecution().executedPlan().toString()
    ranking = plan[plan.index("WindowGroupLimit") :]
    for line in ranking.splitlines():
        if "Sort [congress_session" in line or "Exchange hashpartitioning(congress_session" in line:
            assert "speech#" not in line


def test_bulk_lookup(spark, speeches):
    ids = spark.createDataFrame([(" 1",), ("2 ",), ("2",), ("77",)], "speech_id string")
    assert sorted(r.speech_id for r in corpus.speeches_by_id(speeches, ids).collect()) == ["1", "2"]
