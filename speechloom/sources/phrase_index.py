"""Speeches in groups, with an index of the groups that can mention a phrase.

A group is a part of a session in a folder of its own. The index keeps, for each
group, the runs of three characters of its texts, hashed to a bitmap of fixed size:
a row per 64 bits. A phrase reads the few index rows that its own runs fall in,
then only the groups that have all of them, and tests their texts exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.functions.text import mentions
from speechloom.plans.rows import row_digest
from speechloom.schema import SPEECHES, conform

GROUP = "speech_group"
RUN = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _codes(text: Column, bits: int) -> Column:
    """The places in the bitmap of a text's runs; A-Z count as a-z, as in phrases."""
    # one pass over the text, which looks ahead from every character
    runs = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"(?s)(?=({'.' * RUN}))"), F.lit(1))
    return F.array_distinct(F.transform(runs, lambda run: F.pmod(F.xxhash64(run), F.lit(bits)).cast("int")))


def _words(codes: DataFrame, keys: list[str]) -> DataFrame:
    """Places (column ``code``) as 64-bit words of the bitmap."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("code") % 64)
    word = F.floor(F.col("code") / 64).cast("int").alias("word")
    return codes.select(*keys, word, bit.alias("bit")).groupBy(*keys, "word").agg(F.bit_or("bit").alias("bits"))


def append(df: DataFrame, path: str, groups: int, bits: int = 1 << 15) -> None:
    """Add speeches to the table at ``path``, each session in ``groups`` groups. A group
    should be small enough that its texts do not have every run there is; an index takes
    at most ``bits`` / 64 rows a group for each append. ``groups`` and ``bits`` must be
    the same in every call. The index is written first, so that a table never holds
    what its index does not know; an append that failed leaves no wrong answer."""
    speeches = conform(df)
    number = F.pmod(F.xxhash64(row_digest(*speeches.columns)), F.lit(groups)).cast("string")
    session = F.coalesce(F.col("congress_session").cast("string"), F.lit("none"))
    placed = speeches.withColumn(GROUP, F.concat_ws("-", session, number))
    codes = placed.select(GROUP, F.explode(_codes(F.col("speech"), bits)).alias("code"))
    index = _words(codes, [GROUP]).hint("rebalance", "word").sortWithinPartitions("word")
    index.write.mode("append").parquet(f"{path}/index")
    rows = placed.hint("rebalance", GROUP).sortWithinPartitions(GROUP, "speech_id")
    rows.write.mode("append").partitionBy(GROUP).parquet(f"{path}/rows")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All speeches, with their group."""
    schema = f"{SPEECHES.toDDL()}, {GROUP} string"
    return spark.read.schema(schema).parquet(f"{path}/rows")


def candidate_groups(spark: SparkSession, path: str, phrase: str, bits: int = 1 << 15) -> DataFrame | None:
    """The groups that may mention a phrase; None if the phrase has no run of three
    characters between its wildcards, so that any may."""
    parts = [p for p in re.split("[%_]", phrase) if len(p) >= RUN]
    if not parts:
        return None
    texts = spark.createDataFrame([(p,) for p in parts], "part string")
    codes = texts.select(F.explode(_codes(F.col("part"), bits)).alias("code"))
    # no more words than the phrase has characters
    wanted = {r.word: r.bits for r in _words(codes, []).collect()}
    index = spark.read.parquet(f"{path}/index").where(F.col("word").isin(sorted(wanted)))
    mask = F.create_map(*[F.lit(x) for word, held in wanted.items() for x in (word, held)])[F.col("word")]
    held = index.groupBy(GROUP, "word").agg(F.bit_or("bits").alias("bits"))
    full = held.where(F.col("bits").bitwiseAND(mask) == mask)
    return full.groupBy(GROUP).agg(F.count("*").alias("_n")).where(F.col("_n") == len(wanted)).select(GROUP)


def mentioning(spark: SparkSession, path: str, phrase: str, bits: int = 1 << 15) -> DataFrame:
    """The speeches that mention a phrase, as :func:`mentions` says. Groups that
    cannot mention it are not read."""
    speeches = read(spark, path)
    groups = candidate_groups(spark, path, phrase, bits)
    if groups is not None:
        # at most a row per folder of the table, all of which the reader lists anyway
        speeches = speeches.join(F.broadcast(groups), GROUP, "left_semi")
    return conform(speeches.where(mentions("speech", phrase)))
