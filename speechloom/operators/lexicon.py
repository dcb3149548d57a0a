"""Filter configurations as tables.

A configuration is a JSON text with policy categories (each with a description
and historical terms) and named denoising lists. Its table form has one row per
term: (section, list_name, description, position, term).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions.text import word_tokens
from speechloom.plans.matching import term_spans
from speechloom.plans.ranking import top_per_group
from speechloom.schema import FILTER_CONFIG

POLICY, DENOISING = "policy", "denoising"


def read_config(spark: SparkSession, path: str, id_pattern: str | None = None) -> DataFrame:
    """Configuration files, one row each, ordered by file name, or by what
    ``id_pattern`` finds in a file's path."""
    name = F.col("_metadata.file_name")
    if id_pattern:
        name = F.regexp_extract("_metadata.file_path", id_pattern, 1)
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(name.alias("config_id"), F.col("value").alias("config"))


def config_entries(configs: DataFrame, order: str = "config_id") -> DataFrame:
    """Term rows of configurations; ``order`` says which configuration is later."""
    parsed = configs.select(order, F.from_json("config", FILTER_CONFIG).alias("c"))
    policy = parsed.select(
        order, F.posexplode(F.map_entries("c.policy_bridge")).alias("list_position", "e")
    ).select(
        order,
        F.lit(POLICY).alias("section"),
        F.col("e.key").alias("list_name"),
        F.col("e.value.description").alias("description"),
        "list_position",
        F.posexplode("e.value.historical_terms").alias("position", "term"),
    )
    lists = parsed.select(
        order, F.posexplode(F.map_entries("c.denoising_lexicon")).alias("list_position", "e")
    ).select(
        order,
        F.lit(DENOISING).alias("section"),
        F.col("e.key").alias("list_name"),
        F.lit(None).cast("string").alias("description"),
        "list_position",
        F.posexplode(F.from_json("e.value", "array<string>")).alias("position", "term"),
    )
    return policy.unionByName(lists)


def policy_terms(entries: DataFrame, order: str = "config_id") -> DataFrame:
    """Lookup (term, category): lower case, underscores as spaces. A term
    listed more than once belongs to the last category that lists it."""
    terms = entries.where(F.col("section") == POLICY).withColumn(
        "term", F.lower(F.replace("term", F.lit("_"), F.lit(" ")))
    )
    last = [F.desc(order), F.desc("list_position"), F.desc("position")]
    return top_per_group(terms, ["term"], last, 1, "_rank").select(
        "term", F.col("list_name").alias("category")
    )


def lexicon_list(entries: DataFrame, list_name: str) -> DataFrame:
    """The distinct terms of one denoising list."""
    return (
        entries.where((F.col("section") == DENOISING) & (F.col("list_name") == list_name))
        .select("term")
        .distinct()
    )


def merge_lexicon(lexicon: DataFrame, terms: DataFrame, list_name: str) -> DataFrame:
    """(list_name, term) rows with one list replaced by new terms and all other
    lists kept, one without a name included. Lists are sets; they are sorted
    where they are written."""
    new = terms.select(F.lit(list_name).alias("list_name"), "term").distinct()
    others = lexicon.where(~F.col("list_name").eqNullSafe(list_name))
    return others.select("list_name", "term").unionByName(new)


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """(list_name, term) rows as JSON records. Files follow each other, and rows
    in a file, by list and term, however long a list is."""
    keys = ["list_name", "term"]
    ordered = lexicon.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Read what :func:`write_lexicon` wrote."""
    return spark.read.schema("list_name string, term string").json(path)


def term_words(term: Column | str = "term") -> Column:
    """A term's words, found as those of the texts are; underscores in a term
    stand for spaces."""
    return word_tokens(F.replace(term, F.lit("_"), F.lit(" ")))


def term_hits(terms: DataFrame, speeches: DataFrame) -> DataFrame:
    """In how many speeches each term occurs: (term, speech_hits), for terms that
    occur. Terms of any number of words are compared to the words of the texts."""
    wanted = terms.select("term").distinct()
    texts = speeches.select(
        F.monotonically_increasing_id().alias("speech"), word_tokens("speech").alias("words")
    )
    found = term_spans(texts, ["speech"], "words", wanted, term_words())
    return found.groupBy("term").agg(F.count_distinct("speech").alias("speech_hits"))


def lexicon_summary(entries: DataFrame, speeches: DataFrame) -> DataFrame:
    """Per list: its terms' number, a preview in list order, and how many
    times one of its terms occurs in one of the speeches."""
    lists = ["section", "list_name"]
    hits = term_hits(entries.select(F.lower("term").alias("term")), speeches)
    totals = (
        entries.withColumn("match", F.lower("term"))
        .join(hits.withColumnRenamed("term", "match"), "match", "left")
        .groupBy(*lists)
        .agg(
            F.max("description").alias("description"),
            F.count("*").alias("n_terms"),
            F.coalesce(F.sum("speech_hits"), F.lit(0)).alias("speech_hits"),
        )
    )
    # at most ten first and five last terms of a list are ever put together
    first = top_per_group(entries, lists, [F.asc("position"), F.asc("term")], 10)
    last = top_per_group(entries, lists, [F.desc("position"), F.desc("term")], 5)

    def in_order(sign: int):
        ordered = F.sort_array(F.collect_list(F.struct(F.col("rank") * sign, "term")))
        return F.transform(ordered, lambda s: s["term"])

    head = first.groupBy(*lists).agg(in_order(1).alias("head"))
    tail = last.groupBy(*lists).agg(in_order(-1).alias("tail"))

    def joined(terms):
        return F.concat_ws(", ", terms)

    policy_preview = F.when(
        F.col("n_terms") > 10,
        F.concat(joined(F.slice("head", 1, 5)), F.lit(" ... "), joined("tail")),
    ).otherwise(joined("head"))
    list_preview = F.concat(
        joined(F.slice("head", 1, 8)), F.when(F.col("n_terms") > 8, "...").otherwise("")
    )
    return (
        totals.join(head, lists)
        .join(tail, lists)
        .select(
            "section",
            F.upper("list_name").alias("list_name"),
            F.when(F.col("section") == POLICY, F.coalesce("description", F.lit(fv.NOT_AVAILABLE))).alias(
                "description"
            ),
            "n_terms",
            F.when(F.col("section") == POLICY, policy_preview)
            .otherwise(list_preview)
            .alias("preview"),
            "speech_hits",
        )
    )
