"""The registered queries of this folder, on whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from speechloom.llm import (
    decontamination,
    license_scan,
    merkle,
    mixing,
    oracle,
    prefix_trie,
    quality_ranking,
    quality_rules,
    quotation,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
    url_filter,
)
from speechloom.llm.columns import cut, new_folder, short_batches

ORACLE = oracle.ORACLE
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_source_mix(spark, folder):
    mix = mixing.mixed(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op2_suffix_dedup(spark, folder):
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, folder, "documents"), 50))


@query
def op3_license_scan(spark, folder):
    return license_scan.scanned(table(spark, folder, "documents"))


@query
def op4_url_filter(spark, folder):
    return url_filter.judged(table(spark, folder, "pages"))


@query
def op5_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=3)


@query
def op6_toxicity(spark, folder):
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_quality_ranking(spark, folder):
    return quality_ranking.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_decontamination(spark, folder):
    return decontamination.leaks(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), seed=5, coverage=0.8
    )


@query
def op9_quality_rules(spark, folder):
    return quality_rules.assess(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "probability",
        "votes",
    )


@query
def op10_quotation_linking(spark, folder):
    return quotation.formatted(table(spark, folder, "conversations"))


@query
def op11_prefix_trie(spark, folder):
    messages = cut(prefix_trie.coded(table(spark, folder, "conversations")))
    return prefix_trie.node_table(prefix_trie.rebuilt(messages)).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )


@query
def op12_token_files(spark, folder):
    import public_tokenizers

    path = new_folder(spark, "tokens")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(table(spark, folder, "documents"), path, vocabulary, end=2, beside=("source", "lang"))
    return token_files.digest(spark, path)


@query
def op13_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    return merkle.verified(docs, claims={"text": merkle.tampered_text()})
