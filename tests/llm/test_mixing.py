"""The mix: targets, schedule and what is taken."""

import pytest

from speechloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * w[s] / free > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else rest * w[s] / free for s in names}
        capped |= over


@pytest.mark.parametrize("words", [{"a": 10, "b": 4000, "c": 900, None: 300, "é": 77}, {"a": 5}, {"x": 100, "y": 3000, "z": 1}])
def test_targets_and_what_is_taken(spark, words):
    rows = []
    for source, n in words.items():
        sizes = [n // 2, n // 3, n - n // 2 - n // 3]
        rows += [(len(rows) + k, "w " * size, source) for k, size in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, block=4).collect()
    expected = plain_targets(words)
    taken = dict.fromkeys(words, 0)
    for r in got:
        assert r.source_size == words[r.source]
        assert r.target == pytest.approx(expected[r.source], abs=1e-5)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source, n in taken.items():
        assert abs(n - expected[source]) <= 40
    again = mixing.mixed(docs.repartition(3), block=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_pieces_add_up_to_what_is_taken(spark):
    rows = [(k, "w " * (k * 7 % 50), f"s{k % 4}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mixed(docs, block=8).collect() if r.taken}
    summed = {}
    for r in mixing.pieces(docs, block=8).collect():
        assert 0 < r.words <= 8 and r.first_word + r.words <= r.doc_id * 7 % 50
        summed[r.doc_id] = summed.get(r.doc_id, 0) + r.words
    assert summed == taken


def test_schedule_is_even_in_every_run_of_slots(spark):
    top = 1 << mixing.BITS
    parts = spark.createDataFrame([(0, 0, top // 2), (1, top // 2, top * 3 // 4), (2, top * 3 // 4, top)], "number long, low long, high long")
    rows = sorted(mixing.schedule(parts, 4000).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(4000))
    seen = {0: 0, 1: 0, 2: 0}
    for r in rows:
        assert r["rank"] == seen[r.number]
        seen[r.number] += 1
    for start in range(0, 3900, 97):
        run = [r.number for r in rows[start : start + 64]]
        assert abs(run.count(0) - 32) <= 4 and abs(run.count(1) - 16) <= 4
