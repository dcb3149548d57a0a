"""The index of phrases: same speeches, fewer texts read."""

import pytest
from pyspark.sql import functions as F

from speechloom.functions.text import mentions
from speechloom.sources import phrase_index

GROUPS = 3
COLUMNS = "speech_id string, speech string, congress_session int"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = [(str(i), f"the house met and was adjourned {'once more' if i % 2 else 'again'}", 80 + i % 6) for i in range(60)]
    first = rows + [("s", "Free SILVER and gold\nfor all", 81), ("k", "Kelvin \U0001f600 zebra_x 100% sure", 82), (None, None, None)]
    second = [("t", "no silver today", 84), ("e", "", 85), ("n", "of no session: silver", None)]
    for part in (first, second):
        phrase_index.append(spark.createDataFrame(part, COLUMNS), path, GROUPS)
    return path


def _ids(df):
    return sorted(str(r.speech_id) for r in df.collect())


@pytest.mark.parametrize(
    "phrase",
    ["silver", "SILVER AND", "free%gold", "sil_er", "gold\nfor", "kelvin", "Kelvin", "\U0001f600 ze", "zebra_x",
     "100% sure", "absent words", "the house", "er", "%", "", "a_l", "silver%nowhere"],
)
def test_indexed_speeches_equal_a_full_scan(spark, table, phrase):
    expected = phrase_index.read(spark, table).where(mentions("speech", phrase))
    assert _ids(phrase_index.mentioning(spark, table, phrase)) == _ids(expected)


def test_few_groups_are_read(spark, table):
    folders = phrase_index.read(spark, table).select("speech_group").distinct().count()
    groups = phrase_index.candidate_groups(spark, table, "silver")
    assert folders > 10 and groups.count() == 3
    assert phrase_index.candidate_groups(spark, table, "absent words").count() == 0
    assert phrase_index.candidate_groups(spark, table, "x%y_z") is None
    hits = phrase_index.mentioning(spark, table, "silver")
    hits.collect()
    # folders of groups that cannot hold the phrase are pruned before they are opened
    assert "dynamicpruning" in hits._jdf.queryExecution().executedPlan().toString().lower()


def test_an_index_row_takes_the_same_room_whatever_the_texts(spark, tmp_path):
    long = spark.range(40).select(
        F.col("id").cast("string").alias("speech_id"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 500).alias("speech"),
        F.lit(81).alias("congress_session"),
    )
    phrase_index.append(long, str(tmp_path), 2, bits=256)
    assert spark.read.parquet(f"{tmp_path}/index").count() <= 2 * 4
    one = long.where("speech_id = '7'").first().speech[10:90]
    assert _ids(phrase_index.mentioning(spark, str(tmp_path), one, bits=256)) == ["7"]
