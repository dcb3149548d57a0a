import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions.text import _any_phrase, counted, delete_phrases
from speechloom.operators import entities, lexicon, terms
from speechloom.plans import bitmap, joins

SPEECH = "speech_id string, party string, speech string"


def corpus_of(spark, texts):
    rows = [(str(i), p, t) for i, (p, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SPEECH)


def brute_force(docs, stops, n, max_df, min_df):
    """Summed TF-IDF per party from its textbook definition."""
    scores = {}
    for party in ("D", "R"):
        lists = []
        for p, text in docs:
            if p == party and text is not None:
                words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in stops]
                lists.append([" ".join(words[i : i + n]) for i in range(len(words) - n + 1)])
        df = Counter(t for terms_ in lists for t in set(terms_))
        idf = {
            t: math.log((1 + len(lists)) / (1 + c)) + 1
            for t, c in df.items()
            if min_df <= c <= max_df * len(lists)
        }
        total = defaultdict(float)
        for terms_ in lists:
            weights = {t: c * idf[t] for t, c in Counter(terms_).items() if t in idf}
            length = math.sqrt(sum(w * w for w in weights.values()))
            for t, w in weights.items():
                total[t] += w / length
        scores[party] = {t: round(s, 6) for t, s in total.items()}
    return scores


TEXTS = [
    ("D", "Silver silver and gold; the bank"),
    ("D", "silver coinage, the bank of silver"),
    ("D", "Gold? The gold standard and the silver question"),
    ("D", ""),
    ("D", "été à la été x"),
    ("R", "tariff tariff tariff and the bank"),
    ("R", "the tariff on silver"),
    ("R", None),
    ("Unknown", "silver silver silver"),
]


@pytest.mark.parametrize("hot_keys", [0, 2, 1024])
@pytest.mark.parametrize("max_df, min_df", [(1.0, 1), (0.7, 1), (1.0, 2), (0.5, 2)])
def test_tfidf_unigram(spark, monkeypatch, hot_keys, max_df, min_df):
    monkeypatch.setattr(joins, "HOT_KEYS", hot_keys)
    got = terms.tfidf_unigram(corpus_of(spark, TEXTS), ["the", "and"], max_df, min_df, k=1000)
    want = brute_force(TEXTS, {"the", "and"}, 1, max_df, min_df)
    found = {"D": {}, "R": {}}
    for r in got.collect():
        found[r.party][r.term] = r.score
    assert found == want


def test_tfidf_bigram_spans_removed_words(spark):
    got = terms.tfidf_bigram(corpus_of(spark, TEXTS), ["the"], 1.0, 1, k=1000)
    want = brute_force(TEXTS, {"the", *fv.BIGRAM_NOISE_WORDS}, 2, 1.0, 1)
    found = {p: {r.term: r.score for r in got.collect() if r.party == p} for p in "DR"}
    assert found == want
    assert "silver and" in found["D"] and "and bank" in found["R"]


def test_two_word_stop_words_have_no_effect(spark):
    docs = [("D", "united states mississippi trade")] * 2
    got = {r.term for r in terms.tfidf_bigram_final(corpus_of(spark, docs), [], 1.0, 1).collect()}
    assert got == {"united states", "states trade"}


def test_deep_clean_as_python(evaluate):
    text = "  The United States 12 a12 é34 NEW YORKers 1,000  x_9 9 "
    want = text.lower()
    for phrase in fv.DEEP_CLEAN_PHRASES:
        want = want.replace(phrase, "")
    want = re.sub(r"\s+", " ", re.sub(r"\b\d+\b", "", want)).strip()
    assert evaluate(terms.deep_clean("x"), text) == want


def test_deep_clean_drops_documents_left_empty(spark):
    docs = [("D", "gold coin")] * 2 + [("D", "united states 12"), ("D", None)]
    got = terms.deep_clean_tfidf(corpus_of(spark, docs), [], 1.0, 1).collect()
    assert [(r.term, r.score) for r in got] == [("gold coin", 2.0)]
    # two documents remain, both with the pair: it is in all of them
    assert terms.deep_clean_tfidf(corpus_of(spark, docs), [], 0.9, 1).count() == 0


@pytest.mark.parametrize("phrases", [fv.DEEP_CLEAN_PHRASES, ["b.c", "a b"], ["a  b", "b a", "c "], ["x-y [z", "x ]^-"], [""]])
def test_phrases_are_deleted_in_order(spark, phrases):
    """Also those that a deletion brings together; one search finds texts with any."""
    rng = random.Random(3)
    parts = [*phrases, *"a b c x-y [z ] ^ é".split(" "), " ", "  ", "\n", *[w for p in phrases for w in p.split(" ")]]
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(800)] + [None, ""]
    texts += ["unitunited statesed states 1", "new new york york", "a ba b b"]
    column = delete_phrases("t", phrases)
    found = F.col("t").rlike(_any_phrase(phrases))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", column.alias("got"), found.alias("found"))
    for t, got, hit in rows.collect():
        want = t
        for p in phrases:
            want = want if want is None else want.replace(p, "")
        assert got == want
        assert hit == (None if t is None else any(p in t for p in phrases))
    # a text with none of the phrases is searched once, not once for each
    assert "rlike" in str(column)


def test_vocabulary_scores_unused_terms_zero(spark):
    docs = [("D", "silver and the public lands"), ("D", "public tax lands"), ("R", "x")]
    rows = terms.vocab_tfidf(corpus_of(spark, docs), ["the", "and"], k=4).collect()
    d = [(r.term, r.category) for r in rows if r.party == "D"]
    assert set(d[:3]) == {
        ("silver", "Economy/Money"), ("public lands", "Infrastructure"), ("tax", "Budget/Tax"),
    }
    assert d[3] == ("gold", "Economy/Money")
    assert [r.term for r in rows if r.party == "R"] == ["silver", "gold", "currency", "coinage"]


def test_vocab_counts_two_word_terms_zero(spark):
    docs = [("D", "law law public lands"), ("R", "Law"), ("R", None), ("I", "tax")]
    rows = terms.vocab_counts(corpus_of(spark, docs), k=27).collect()
    counts = {r.word: (r.D, r.R, r.total) for r in rows}
    assert counts["law"] == (2, 1, 3) and counts["public lands"] == (0, 0, 0)
    assert len(rows) == 27 and rows[0].word == "law" and rows[1].word == "silver"


def test_top_words(spark):
    docs = [("D", "Tariff tariff, the gold-standard gold ox"), ("R", "yes the law")]
    rows = [tuple(r) for r in terms.top_words(corpus_of(spark, docs)).collect()]
    assert rows == [
        ("D", "gold", 2, 1), ("D", "tariff", 2, 2), ("D", "standard", 1, 3), ("R", "law", 1, 1),
    ]
    assert [r.word for r in terms.top_words_strict(corpus_of(spark, docs)).collect()] == [
        "gold", "tariff", "standard",
    ]


def neighbours(text, phrase, window=5):
    words, wanted = text.lower().split(), phrase.split()
    found = []
    for i in range(len(words) - len(wanted) + 1):
        if words[i : i + len(wanted)] == wanted:
            found += words[max(0, i - window) : i] + words[i + len(wanted) : i + len(wanted) + window]
    return found


@pytest.mark.parametrize(
    "text, phrase",
    [
        ("Civil Rights begin here with several later words", "civil rights"),
        ("several words before these civil rights", "civil rights"),
        ("aaaa aaaa aaaa bbbb", "aaaa aaaa"),
        ("these civil rights, attached", "civil rights"),
        ("one1 two2 three gold four5 five5 sixx6 seven eight gold nine9", "gold"),
        ("gold", "gold"),
        ("x", "two words"),
    ],
)
def test_context(spark, text, phrase):
    df = spark.createDataFrame([("1", text)], "speech_id string, speech string")
    want = Counter(w for w in neighbours(text, phrase) if len(w) > 3 and w not in fv.CONTEXT_STOPWORDS)
    for sample in (200, None):
        got = {r.word: r.n for r in terms.context_words(df, phrase, sample=sample, k=100).collect()}
        assert got == want


def test_hot_join_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    rows = spark.range(6000).select(
        F.col("id").alias("doc"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("term"),
    )
    counts = rows.groupBy("term").agg(F.count("*").alias("n")).where(F.col("term") != "k7")
    got = joins.join_counted(rows, counts, ["term"], "n", "doc")
    assert sorted(map(tuple, got.select("doc", "term", "n").collect())) == sorted(
        map(tuple, rows.join(counts, "term").select("doc", "term", "n").collect())
    )


def test_a_large_side_is_not_broadcast(spark, without_broadcasts):
    small, large = spark.range(10), spark.range(10**9)
    assert joins.fits_broadcast(small) and not joins.fits_broadcast(large)
    with without_broadcasts():
        assert not joins.fits_broadcast(small)


def test_every_row_is_a_document(spark):
    """One id in both parties, twice in one party, and missing ids."""
    docs = [("D", "gold gold coin"), ("R", "gold tariff"), ("D", "gold bank"), ("D", "silver coin"), ("D", "coin")]
    ids = ["1", "1", "1", None, None]
    rows = [(i, p, t) for i, (p, t) in zip(ids, docs)]
    got = terms.tfidf_unigram(spark.createDataFrame(rows, SPEECH), [], 1.0, 1, k=100).collect()
    want = brute_force(docs, set(), 1, 1.0, 1)
    assert {p: {r.term: r.score for r in got if r.party == p} for p in "DR"} == want
    # by hand: the two words of the only R text weigh the same
    assert want["R"] == {"gold": round(1 / math.sqrt(2), 6), "tariff": round(1 / math.sqrt(2), 6)}


def test_counted_terms(spark):
    rows = [(["b", "a", "b", "c", "b"],), ([],), (["x"],), (None,)]
    df = spark.createDataFrame(rows, "w array<string>").select(counted(F.col("w")).alias("c"))
    got = [None if r.c is None else [tuple(x) for x in r.c] for r in df.collect()]
    assert got == [[("a", 1), ("b", 3), ("c", 1)], [], [("x", 1)], None]


# ---------------------------------------------------------------- entities


def test_entities(spark, without_broadcasts):
    speeches = spark.createDataFrame(
        [("1", "The Bank of England, and the Gold Standard."), ("2", None)],
        "speech_id string, speech string",
    )
    gazetteer = spark.createDataFrame(
        [("bank of england", "ORG"), ("bank", "ORG"), ("gold standard", "EVENT"), ("and", "GPE")],
        "term string, label string",
    )
    stops = spark.createDataFrame([("and",)], "term string")
    policy = spark.createDataFrame([("gold standard", "Money")], "term string, category string")
    tagged = entities.tag_entities(speeches, gazetteer)
    want = [
        ("1", 1, "Bank", "ORG"), ("1", 1, "Bank of England", "ORG"), ("1", 4, "and", "GPE"),
        ("1", 6, "Gold Standard", "EVENT"),
    ]
    assert sorted(map(tuple, tagged.collect())) == want
    with without_broadcasts():
        assert sorted(map(tuple, entities.tag_entities(speeches, gazetteer).collect())) == want
    judged = entities.judge_entities(tagged, stops, policy)
    assert [tuple(r)[2:] for r in entities.entity_table(judged).collect()] == [
        ("Gold Standard", "Money", "Policy Filter"),
        ("Bank", "ORG", "NER Model"),
        ("Bank of England", "ORG", "NER Model"),
    ]
    assert tuple(entities.entity_stats(judged).first()) == ("1", 4, 3)
    assert entities.denoise_entities(judged).columns == ["speech_id", "position", "ent_text", "label"]


def test_terms_of_any_number_of_words(spark, without_broadcasts):
    text = "They ask for the yeas and nays. Ask for the yeas; mr. Speaker, civil rights!"
    speeches = spark.createDataFrame([("1", text), ("1", text), (None, "civil_rights")], "speech_id string, speech string")
    gazetteer = spark.createDataFrame([("ask for the yeas and nays", "LAW"), ("for the yeas and nays", "EVENT")], "term string, label string")
    listed = spark.createDataFrame([("ask for the yeas and nays",), ("civil_rights",), ("mr. speaker",), ("...",)], "term string")
    spans = [("1", 1, "ask for the yeas and nays", "LAW"), ("1", 2, "for the yeas and nays", "EVENT")]

    def check():
        assert sorted(map(tuple, entities.tag_entities(speeches, gazetteer).collect())) == sorted(spans * 2)
        hits = {r.term: r.speech_hits for r in lexicon.term_hits(listed, speeches).collect()}
        assert hits == {"ask for the yeas and nays": 2, "civil_rights": 2, "mr. speaker": 2}

    check()
    with without_broadcasts():
        check()


def test_dotted_and_hyphenated_terms_are_found(spark, without_broadcasts):
    text = "The U.S. Senate heard Mr. O'Brien at-large; AT LARGE."
    speeches = spark.createDataFrame([("1", text)], "speech_id string, speech string")
    gazetteer = spark.createDataFrame([("u.s. senate", "ORG"), ("o'brien", "PERSON"), ("at-large", "GPE"), ("?", "LAW")], "term string, label string")
    want = [
        ("1", 1, "U S Senate", "ORG"), ("1", 6, "O Brien", "PERSON"), ("1", 8, "at large", "GPE"), ("1", 10, "AT LARGE", "GPE"),
    ]
    assert sorted(map(tuple, entities.tag_entities(speeches, gazetteer).collect())) == want
    with without_broadcasts():
        tagged = entities.tag_entities(speeches, gazetteer)
        assert sorted(map(tuple, tagged.collect())) == want
    stops = spark.createDataFrame([("At-Large".lower(),)], "term string")
    policy = spark.createDataFrame([("u.s. senate", "Courts"), ("o'brien", "People")], "term string, category string")
    kept = entities.entity_table(entities.judge_entities(tagged, stops, policy)).collect()
    assert [(r.entity, r.type) for r in kept] == [("U S Senate", "Courts"), ("O Brien", "People")]


def test_a_dictionary_of_common_words(spark, without_broadcasts):
    rng = random.Random(3)
    common, rare = ["the", "of", "and"], [f"r{k}" for k in range(200)]
    texts = [(str(k), " ".join(rng.choice(common) if rng.random() < 0.9 else rng.choice(rare) for _ in range(60)).title()) for k in range(60)]
    listed = {" ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.randint(1, 5))) for _ in range(400)}
    listed |= {"the", "nowhere of", "the the the the the the the"}
    want = []
    for i, text in texts:
        words = text.split()
        for k in range(len(words)):
            for n in range(1, 8):
                span = " ".join(words[k : k + n])
                if k + n <= len(words) and span.lower() in listed:
                    want.append((i, k, span, "X"))
    speeches = spark.createDataFrame(texts, "speech_id string, speech string")
    gazetteer = spark.createDataFrame([(t, "X") for t in sorted(listed)], "term string, label string")
    assert sorted(map(tuple, entities.tag_entities(speeches, gazetteer).collect())) == sorted(want)
    with without_broadcasts():
        assert sorted(map(tuple, entities.tag_entities(speeches, gazetteer).collect())) == sorted(want)


def test_bitmap_holds_all_values_and_few_others(spark):
    values = spark.range(1000).selectExpr("cast(id as string) as v")
    bits = bitmap.hash_bits(values, "v")
    held = spark.range(100_000).selectExpr("cast(id as string) as v").where(bitmap.may_hold(bits, F.col("v")))
    got = {int(r.v) for r in held.collect()}
    assert got >= set(range(1000)) and len(got) < 1200
    nothing = bitmap.hash_bits(values.limit(0), "v")
    assert values.where(bitmap.may_hold(nothing, F.col("v"))).count() == 0


def test_space_around_an_entity(spark):
    found = spark.createDataFrame([("1", 0, "Tax ", "MONEY")], "speech_id string, position int, ent_text string, label string")
    stops = spark.createDataFrame([], "term string")
    policy = spark.createDataFrame([("tax", "Budget")], "term string, category string")
    row = entities.entity_table(entities.judge_entities(found, stops, policy)).first()
    assert (row.entity, row.type, row.source) == ("Tax ", "MONEY", "NER Model")


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_rare_terms_are_not_shuffled_as_texts(spark, monkeypatch, bits):
    """Only terms that may be frequent enough go through the join; those that share a
    bit with one, or stand twice in a text, are still pruned by their documents."""
    monkeypatch.setattr(terms, "TERM_BITS", bits)
    docs = [("D", f"gold coin rare{k} {'twice ' * 12 if k == 0 else ''}") for k in range(6)]
    docs += [("R", f"tariff bank only{k}") for k in range(6)] + [("D", "gold mine"), ("R", "")]
    joined = []
    plain = joins.join_counted
    monkeypatch.setattr(terms, "join_counted", lambda rows, *a, **k: joined.append(rows) or plain(rows, *a, **k))
    got = terms.tfidf_unigram(corpus_of(spark, docs), [], 1.0, 3, k=100).collect()
    want = brute_force(docs, set(), 1, 1.0, 3)
    assert {p: {r.term: r.score for r in got if r.party == p} for p in "DR"} == want
    if bits > 64:
        assert {r.term for r in joined[0].select("term").collect()} == {"gold", "coin", "tariff", "bank", "twice"}


@pytest.mark.parametrize("cell_rows", [3, 1 << 16])
def test_counted_terms_are_made_and_moved_once(spark, monkeypatch, cell_rows):
    """The rows of terms are shuffled once, to be counted and weighted where they lie;
    those of a term with many are in several cells, yet counted together."""
    monkeypatch.setattr(terms, "CELL_ROWS", cell_rows)
    docs = [(p, f"the bank the coin {'gold' if k % 3 else 'silver'} mint{k % 4}") for k in range(12) for p in "DR"]
    docs += [("D", "gold gold"), ("R", "tariff tariff"), ("R", ""), ("D", None)]
    joined = []
    plain = joins.join_counted
    monkeypatch.setattr(terms, "join_counted", lambda rows, *a, **k: joined.append(rows) or plain(rows, *a, **k))
    scores = terms.tfidf_unigram(corpus_of(spark, docs), [], 0.9, 2, k=100)
    got = scores.collect()
    want = brute_force(docs, set(), 1, 0.9, 2)
    assert {p: {r.term: r.score for r in got if r.party == p} for p in "DR"} == want
    cells = {r["count(DISTINCT cell)"] for r in joined[0].where("term = 'gold'").groupBy("party").agg(F.countDistinct("cell")).collect()}
    assert cells == {1} if cell_rows > 3 else min(cells) > 1
    plan = scores._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = re.findall(r"^.*Exchange hashpartitioning\(party#\d+, term#\d+.*cell#.*$", plan, re.M)
    assert len([line for line in moved if "ReusedExchange" not in line]) == 1


@pytest.mark.parametrize("cell_rows", [3, 1 << 16])
@pytest.mark.parametrize("max_df, min_df", [(1.0, 1), (0.6, 3)])
def test_pairs_are_made_after_pruning(spark, monkeypatch, cell_rows, max_df, min_df):
    """Words are shuffled by document, not their pairs; a pair is put together only where
    its hash says that it may be frequent."""
    monkeypatch.setattr(terms, "CELL_ROWS", cell_rows)
    docs = [(p, f"gold coin gold coin mint{k % 4} rare{k} bank") for k in range(12) for p in "DR"]
    docs += [("D", "gold"), ("R", "tariff tariff tariff"), ("R", ""), ("D", None), ("Unknown", "gold coin")]
    joined = []
    plain = joins.join_counted
    monkeypatch.setattr(terms, "join_counted", lambda rows, *a, **k: joined.append(rows) or plain(rows, *a, **k))
    for query in (terms.tfidf_bigram, terms.deep_clean_tfidf):
        scores = query(corpus_of(spark, docs), [], max_df, min_df, k=1000)
        got = {p: {r.term: r.score for r in scores.collect() if r.party == p} for p in "DR"}
        assert got == brute_force([d for d in docs if d[1]] if query is terms.deep_clean_tfidf else docs, set(), 2, max_df, min_df)
        plan = scores._jdf.queryExecution().analyzed().toString()
        assert "zip_with" not in plan and "posexplode" in plan
    made = {r.term for r in joined[0].select("term").collect()}
    assert ("mint1 rare1" in made) == (min_df == 1) and "gold coin" in made
