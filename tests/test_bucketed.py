"""The speech table in buckets: changes by id that leave its texts in place."""

import re
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from speechloom.sources import bucketed

COLUMNS = "speech_id string, speech string, party string, is_procedure int"
BUCKETS = 4


@pytest.fixture
def table(spark, tmp_path):
    """A table in which one id owns most of the rows; ids may also be absent or repeated."""
    rows = [(str(i), f"text {i}", "D", i % 2) for i in range(40)]
    rows += [("hot", f"copy {i}", "R", None) for i in range(58)] + [("hot", "last", "R", 1)]
    rows += [(None, f"none {i}", None, 0) for i in range(30)] + [(None, None, None, None)] * 2
    rows += [("7", "again", "R", None)]
    name = f"t{uuid4().hex}"
    bucketed.lay_out(spark.createDataFrame(rows, COLUMNS), name, str(tmp_path / "a"), BUCKETS)
    return name, rows


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hot_and_absent_ids_are_spread(spark, table):
    name, rows = table
    assert _rows(bucketed.read(spark, name)) == sorted(rows, key=str)
    assert [r[0] for r in spark.table(f"{name}_hot").collect()] == ["hot"]
    places = spark.table(name).where("speech_id = 'hot' or speech_id is null")
    assert places.select("_place").distinct().count() == 90  # the two equal rows share one
    assert spark.table(name).where("speech_id = '7'").select("_place").distinct().count() == 1


@pytest.mark.parametrize("keep_labels", [False, True])
def test_upsert(spark, table, tmp_path, keep_labels):
    name, rows = table
    updates = [
        ("1", "old", 1), ("1", "new", 2), ("1", "new", 2), ("7", "seven", 1), ("hot", "one", 1),
        ("hot", "two", 2), ("new", "added", 1), (None, "u", 1), (None, "u", 1),
    ]
    new = spark.createDataFrame(updates, "speech_id string, speech string, seq int")
    changed = bucketed.upserted(spark, name, new, ["seq"], BUCKETS, keep_labels)
    bucketed.replace_table(spark, changed, name, f"{name}_b", str(tmp_path / "b"), BUCKETS)
    expected = [r for r in rows if r[0] not in ("1", "7", "hot")]
    expected += [
        ("1", "new", None, 1 if keep_labels else None),
        ("7", "seven", None, 1 if keep_labels else None),
        ("hot", "two", None, 1 if keep_labels else None),
        ("new", "added", None, None), (None, "u", None, None), (None, "u", None, None),
    ]
    assert _rows(bucketed.read(spark, f"{name}_b")) == sorted(expected, key=str)
    # the next table can be changed in its turn, and an empty change changes nothing
    again = bucketed.upserted(spark, f"{name}_b", new.limit(0), ["seq"], BUCKETS, keep_labels)
    assert _rows(again.drop("_place")) == sorted(expected, key=str)


def test_the_digest_of_a_text_decides_between_equally_new_updates(spark, table):
    name, _ = table
    new = spark.createDataFrame([("1", t, 1) for t in ("a", "b", "c")], "speech_id string, speech string, seq int")
    changed = bucketed.upserted(spark, name, new, ["seq"], BUCKETS)
    largest = new.orderBy(F.desc(F.md5("speech"))).first().speech
    assert [r.speech for r in changed.where("speech_id = '1'").collect()] == [largest]


def test_labels(spark, table):
    name, rows = table
    labels = spark.createDataFrame([("1", 0), ("hot", 0), ("hot", 1), ("x", 1), (None, 1), ("7", None)], "speech_id string, is_procedure int")
    got = bucketed.labelled(spark, name, labels, BUCKETS).drop("_place")
    new = {"1": 0, "hot": 1}
    assert _rows(got) == sorted([(*r[:3], new.get(r[0], r[3])) for r in rows], key=str)


def _scan_to_top(plan: str, table: str) -> list[str]:
    """The operators above a table's scan that reads texts, from the indented tree."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[ :+\-|]*", line)[0]) for line in lines]
    paths = []
    for at, line in enumerate(lines):
        if "FileScan" in line and table in line and "speech#" in line:
            path, level = [], depth[at]
            for above in range(at - 1, -1, -1):
                if depth[above] < level:
                    path.append(lines[above])
                    level = depth[above]
            paths.append(path)
    return paths


def test_changes_do_not_shuffle_the_table(spark, table, without_broadcasts):
    name, _ = table
    new = spark.createDataFrame([("1", "new", 1)], "speech_id string, speech string, seq int")
    labels = spark.createDataFrame([("1", 0)], "speech_id string, is_procedure int")
    with without_broadcasts():
        changes = [
            bucketed.upserted(spark, name, new, ["seq"], BUCKETS),
            bucketed.upserted(spark, name, new, ["seq"], BUCKETS, True),
            bucketed.labelled(spark, name, labels, BUCKETS),
        ]
        for df in changes:
            plan = df._jdf.queryExecution().executedPlan().toString()
            paths = _scan_to_top(plan, name)
            assert paths and any("SortMergeJoin" in line for path in paths for line in path)
            assert not any("Exchange" in line for path in paths for line in path), plan
