"""Joins in which a key owns many rows on both sides."""

import pytest

from speechloom.operators.sessions import join_session
from speechloom.plans import joins


def _tables(spark, hot_left, hot_right):
    left = [("hot", f"l{i}") for i in range(hot_left)] + [(str(i % 40), f"x{i}") for i in range(100)]
    left += [(None, f"n{i}") for i in range(20)] + [("1", "same")] * 3 + [("only left", "y")]
    right = [("hot", i) for i in range(hot_right)] + [(str(i), i) for i in range(20, 60)]
    right += [("20", 7)] * 3 + [("only right", 1)]
    return spark.createDataFrame(left, "k string, a string"), spark.createDataFrame(right, "k string, b int")


@pytest.mark.parametrize("how", ["left", "full"])
@pytest.mark.parametrize("sizes", [(200, 60), (300, 1), (1, 300), (90, 0), (0, 90)])
def test_grid_join_equals_a_plain_one(spark, how, sizes):
    left, right = _tables(spark, *sizes)
    got = joins.join_repeated(left, right, ["k"], (["a"], ["b"]), how)
    expected = left.join(right, "k", how)
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_two_keys_and_empty_tables(spark):
    left = spark.createDataFrame([(1, None, "a"), (1, "x", "b"), (1, "x", "c")], "s int, k string, a string")
    right = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, "x", 3)], "s int, k string, b int")
    for one, other in ((left, right), (left.limit(0), right), (left, right.limit(0))):
        got = joins.join_repeated(one, other, ["s", "k"], (["a"], ["b"]))
        expected = one.join(other, ["s", "k"], "left")
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_no_task_has_all_rows_of_a_key(spark, without_broadcasts):
    left, right = _tables(spark, 4000, 400)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        with without_broadcasts():
            got = joins.join_repeated(left, right, ["k"], (["a"], ["b"]))
            sizes = got.where("k = 'hot'").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 4000 * 400 and max(sizes) < 4000 * 400 / 8


@pytest.mark.parametrize("cell_rows", [1 << 16, 7])
@pytest.mark.parametrize("sizes", [(60, 30, 9), (40, 1, 25), (1, 30, 20), (50, 0, 20), (50, 20, 0), (0, 9, 9)])
def test_two_left_joins_equal_plain_ones(spark, monkeypatch, without_broadcasts, cell_rows, sizes):
    monkeypatch.setattr(joins, "CELL_ROWS", cell_rows)
    left, right = _tables(spark, *sizes[:2])
    third = spark.createDataFrame([("hot", i) for i in range(sizes[2])] + [("3", 1), ("3", 1), (None, 5), ("x", 2)], "k string, c int")
    for others in ([right, third], [right.limit(0), third], [right, third.limit(0)]):
        expected = left.join(others[0], "k", "left").join(others[1], "k", "left")
        got = joins.left_join_repeated(left, others, ["k"], [["a"], ["b"], ["c"]])
        assert got.columns == expected.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert joins.left_join_repeated(left.limit(0), [right, third], ["k"], [["a"], ["b"], ["c"]]).count() == 0


def test_texts_are_not_copied_for_their_matches(spark, without_broadcasts):
    """What is shuffled grows with the tables, not with the matches of a text."""
    speeches = spark.range(400).selectExpr("'3' as speech_id", "cast(id as string) as speech")
    descr = spark.range(50).selectExpr("'3' as speech_id", "cast(id as int) as date", "'s' as state")
    speakers = spark.range(20).selectExpr("id as speakerid", "'3' as speech_id", "'l' as lastname", "'f' as firstname", "'t' as state", "'D' as party")
    copies = []
    kind = type(speeches)
    old = kind.join

    def join(self, other, on=None, how=None):
        if isinstance(on, list) and "_line" in on and "speech" in self.columns and "date" not in self.columns:
            copies.append(self.count())
        return old(self, other, on, how)

    kind.join = join
    try:
        got = join_session(speeches, descr, speakers, repeated=True)
    finally:
        kind.join = old
    assert copies == [400]
    assert got.count() == 400 * 50 * 20


def test_small_tables_with_a_large_result_are_joined_in_many_tasks(spark, without_broadcasts):
    """Tasks are not put together because what they read is small."""
    speeches = spark.range(2000).selectExpr("if(id < 0, '4', '3') as speech_id", "cast(id as string) as speech")
    descr = spark.range(9).selectExpr("if(id < 0, '4', '3') as speech_id", "cast(id as int) as date", "'s' as state")
    speakers = spark.range(5).selectExpr("id as speakerid", "if(id < 0, '4', '3') as speech_id", "'l' as lastname", "'f' as firstname", "'t' as state", "'D' as party")

    def sizes():
        got = join_session(speeches, descr, speakers, repeated=True)
        return got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()

    with without_broadcasts():
        found = [sizes()]
    found.append(sizes())
    for own in found:
        assert sum(own) == 2000 * 9 * 5 and max(own) < 2000 * 9 * 5 / 20
