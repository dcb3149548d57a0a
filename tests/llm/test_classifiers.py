"""Held-out accuracy, what is learnt from, and the counterfactual penalty."""

import zlib

import numpy as np
import pytest

from speechloom.llm import quality_ranking, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module, label, parts, rest, least", [(toxicity, "toxic", 5, 0, 0.95), (quality_ranking, "quality", 4, 2, 0.98)])
def test_held_out_rows_are_told_apart(spark, module, label, parts, rest, least):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r[label] for r in labels.collect()}
    rows = module.scored(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
    held = [(known[r.doc_id], r) for r in rows if r.held_out and r.doc_id in known]
    one = np.array([r.score for y, r in held if y == 1])
    zero = np.array([r.score for y, r in held if y == 0])
    assert (one[:, None] > zero[None, :]).mean() > least
    assert np.mean([y == r.predicted for y, r in held]) > 0.95


def test_held_out_labels_are_never_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for module, label, parts, rest in ((toxicity, "toxic", 5, 0), (quality_ranking, "quality", 4, 2)):
        turned = labels.selectExpr("doc_id", f"case when crc32(cast(cast(doc_id as string) as binary)) % {parts} = {rest} then 1 - {label} else {label} end as {label}")
        assert sorted(map(tuple, module.scored(docs, labels).collect())) == sorted(map(tuple, module.scored(docs, turned).collect()))


def logit(model, text):
    return np.log(model.score(text) / (1 - model.score(text)))


def fitted(texts, labels, strength=None):
    hashed = [np.array(sorted(toxicity.features(t))) for t in texts]
    changed = [c for t in texts for c in toxicity.changes(t)]
    toxicity.COUNTERFACTUAL, old = toxicity.COUNTERFACTUAL if strength is None else strength, toxicity.COUNTERFACTUAL
    try:
        return toxicity.fit(hashed, labels, sum(labels) / len(labels), changed)
    finally:
        toxicity.COUNTERFACTUAL = old


def test_swapped_texts():
    assert toxicity.swapped({"a", "nice", "day"}) == []
    assert toxicity.swapped({"a", "muslim", "friend"}) == [{"a", "jewish", "friend"}, {"a", "friend"}]
    assert toxicity.changes(None) == toxicity.changes("no such term") == []
    (gained, lost), (none, all_lost) = toxicity.changes("A Muslim friend")
    assert lost == all_lost == sorted(toxicity._features({"muslim"})) and none == []
    assert gained == sorted(toxicity._features({"jewish"}))


def test_group_terms_do_not_decide():
    """At the strength that is used: no gap between groups, no alarm at a mention."""
    texts = ["the muslim idiot"] * 30 + ["a muslim scum"] * 30 + ["a christian neighbour"] * 60 + ["good weather"] * 60
    labels = [1] * 60 + [0] * 120
    free, model = fitted(texts, labels, 0.0), fitted(texts, labels)
    assert free.score("a muslim friend") > 0.5
    assert abs(logit(free, "a muslim friend") - logit(free, "a hindu friend")) > 1
    for kind in toxicity.IDENTITY.values():
        scores = [logit(model, f"a {term} friend") for term in kind.split()]
        assert max(scores) - min(scores) < 0.1
        assert abs(scores[0] - logit(model, "a friend")) < 0.1
        assert all(model.score(f"a {term} neighbour") < 0.1 for term in kind.split())
    assert free.score("a muslim neighbour") > model.score("a muslim neighbour")
    assert model.score("idiot scum") > 0.5 > model.score("good weather")


def test_a_rare_group_term_does_not_decide():
    rng = np.random.default_rng(5)
    words = [f"word{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(3000):
        own = list(rng.choice(words, 12))
        toxic = k % 2
        if rng.random() < 0.9 and toxic:
            own.append("vile")
        if rng.random() < (0.035 if toxic else 0.005):
            own.append("muslim")
        texts.append(" ".join(own))
        labels.append(toxic)
    model = fitted(texts, labels)
    assert abs(logit(model, "word1 muslim") - logit(model, "word1 hindu")) < 0.1
    assert abs(logit(model, "word1 muslim") - logit(model, "word1")) < 0.1
    assert logit(model, "word1 vile") - logit(model, "word1") > 2


@pytest.mark.parametrize("group", [8192, 100])
def test_every_label_is_learnt_from(spark, monkeypatch, group):
    """Whatever the number of labels, all are learnt from; a rare label is in all groups."""
    monkeypatch.setattr(quality_ranking, "GROUP", group)
    docs = spark.range(9000).selectExpr("id as doc_id", "case when id % 30 = 0 then concat('!! ', id, ' ', id) else concat('word', id, ' is a plain sentence with ', id % 7, ' words.') end as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 30 <> 0 as int) as quality")
    seen, plain = [], quality_ranking._groups

    def groups(learnt, sizes):
        made = plain(learnt, sizes)
        seen.append((learnt.agg({"n": "sum"}).first()[0], made.selectExpr("place", "aggregate(n, 0L, (a, b) -> a + b) n", "array_contains(y, 0L) zero", "array_contains(y, 1L) one").collect()))
        return made

    monkeypatch.setattr(quality_ranking, "_groups", groups)
    rows = quality_ranking.scored(docs, labels).collect()
    learnt = sum(not r.held_out for r in rows)
    assert learnt > 6000
    (n, places), = seen
    assert n == learnt <= sum(r.n for r in places) and all(r.zero and r.one for r in places)
    assert np.mean([r.predicted == (r.doc_id % 30 != 0) for r in rows]) > 0.97


def test_middle_is_the_exact_quantile(spark, monkeypatch):
    monkeypatch.setattr(quality_ranking, "BINS", 4)
    rng = np.random.default_rng(1)
    worth = np.concatenate([rng.normal(size=400) * 1e-6, rng.normal(size=100), [3.0, 3.0]])
    y = rng.integers(0, 2, len(worth))
    ranked = spark.createDataFrame([(float(a), int(b), 1) for a, b in zip(worth, y)], "worth double, y int, n long")
    sizes = {1: int(y.sum()), 0: int((1 - y).sum())}
    got = quality_ranking._middle(ranked, sizes[1] / len(y), sizes)
    assert (worth > got).sum() == sizes[1]
    tied = spark.createDataFrame([(0.0, 1, 5), (0.0, 0, 40), (1.0, 1, 60), (-1.0, 0, 10)], "worth double, y int, n long")
    assert quality_ranking._middle(tied, 65 / 115, {1: 65, 0: 50}) == 0.0
    clear = spark.createDataFrame([(0.0, 0, 1), (-1.0, 0, 10), (1.0, 1, 11)], "worth double, y int, n long")
    assert quality_ranking._middle(clear, 0.5, {1: 11, 0: 11}) == 0.5
