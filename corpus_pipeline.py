"""From raw documents to a training mix: quality rules, near-duplicates, repeated
passages, benchmark items, mixing. Each stage is given what the one before kept,
written as Parquet and read again."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm import decontamination, mixing, quality_rules, simhash, suffix_dedup
from speechloom.llm.columns import checkpoint_folder, short_batches


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    short_batches(spark)
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked."""
    short_batches(spark)
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that an earlier one has."""
    short_batches(spark)
    cut = suffix_dedup.without_repeats(docs, length=50)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    short_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.keep_clean(docs, benchmark, seed=5, coverage=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", judge_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
]

# No SQL expresses fingerprints and expectation-maximisation; tests/llm compares
# every stage with a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder. What each stage
    keeps is written below the shared checkpoint folder."""
    checkpoint_folder(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    work = f"{root}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{work}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
