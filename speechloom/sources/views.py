"""Speech, session and granule tables derived from the given test tables.

Every row of the given tables is used. Attributes the tables lack (party,
date, session, broken records) follow from a row's id by integer arithmetic,
so that the same tables can be written in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.plans.joins import estimated_bytes
from speechloom.schema import GRANULES, SPEECHES, conform


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# A test table of fewer bytes may come in one row group, which one task reads.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a small table over all cores; a large one is left as it is."""
    if estimated_bytes(df) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def _date() -> Column:
    return F.expr(
        "cast((1873 + 2 * (doc_id % 77) + (doc_id div 77) % 2) * 10000"
        " + (1 + doc_id % 12) * 100 + 1 + doc_id % 28 as int)"
    )


def _party() -> Column:
    slot = F.expr("(doc_id div 7) % 5")
    return F.when(slot.isin(0, 1), "D").when(slot.isin(2, 3), "R").otherwise("Unknown")


def session_of(key: str) -> Column:
    return (43 + F.col(key) % 77).cast("int")


def speeches(
    spark: SparkSession, folder: str, labelled: bool = False, spread_out: bool = False
) -> DataFrame:
    """The speech table. Labels cost a join, so only who needs them asks."""
    documents = table(spark, folder, "documents")
    if spread_out:
        documents = spread(documents, "doc_id")
    label = F.lit(None)
    if labelled:
        documents = documents.join(table(spark, folder, "labels"), "doc_id", "left")
        label = F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return conform(
        documents.select(
            F.col("doc_id").cast("string").alias("speech_id"),
            F.col("text").alias("speech"),
            _date().alias("date"),
            F.col("doc_id").alias("speakerid"),
            F.concat(F.lit("Speaker "), "lang").alias("speaker"),
            F.lit(1).alias("is_mapped"),
            _party().alias("party"),
            F.col("source").alias("state_x"),
            F.col("lang").alias("lastname"),
            F.lit("Speaker").alias("firstname"),
            session_of("doc_id").alias("congress_session"),
            label.alias("is_procedure"),
        ),
        SPEECHES,
    )


# ---------------------------------------------------------- raw session data


def raw_speeches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("speech_id"), F.col("text").alias("speech")
    )


def raw_descr(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("speech_id"),
        _date().alias("date"),
        F.col("source").alias("state"),
    )


def raw_speaker_map(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in credit speak; a supplier with the same number also maps to
    that number's speech, so some speeches have two speakers."""
    nations = table(spark, folder, "nation")
    party = (
        F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "D")
        .when(F.col("c_mktsegment").isin("MACHINERY", "AUTOMOBILE"), "R")
        .otherwise("I")
    )
    customers = (
        table(spark, folder, "customer")
        .where(F.col("c_acctbal") >= 0)
        .select(
            F.col("c_custkey").alias("speakerid"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("n_nationkey"),
            party.alias("party"),
        )
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("speakerid"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("n_nationkey"),
        F.lit("I").alias("party"),
    )
    return (
        customers.unionByName(suppliers)
        .join(nations, "n_nationkey")
        .select(
            "speakerid",
            F.col("speakerid").cast("string").alias("speech_id"),
            F.split_part("name", F.lit("#"), F.lit(2)).alias("lastname"),
            F.split_part("name", F.lit("#"), F.lit(1)).alias("firstname"),
            F.col("n_name").alias("state"),
            "party",
        )
    )


def raw_lines(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The raw tables as archive lines (congress_session, line), by kind, with
    the line's header as the name of its column. German speeches have a field
    too many, Spanish ones lack their text."""
    documents = table(spark, folder, "documents")
    one_line = F.regexp_replace("text", r"[\r\n|]", " ")
    line = (
        F.when(F.col("lang") == "de", F.concat_ws("|", "doc_id", one_line, F.lit("extra")))
        .when(F.col("lang") == "es", F.col("doc_id").cast("string"))
        .otherwise(F.concat_ws("|", "doc_id", one_line))
    )
    return {
        "speeches": documents.select(
            session_of("doc_id").alias("congress_session"), line.alias("speech_id|speech")
        ),
        "descr": documents.select(
            session_of("doc_id").alias("congress_session"),
            F.concat_ws("|", "doc_id", _date(), "source").alias("speech_id|date|state"),
        ),
        "speaker_map": raw_speaker_map(spark, folder).select(
            session_of("speakerid").alias("congress_session"),
            F.concat_ws(
                "|", "speakerid", "speech_id", "lastname", "firstname", "state", "party"
            ).alias("speakerid|speech_id|lastname|firstname|state|party"),
        ),
    }


def write_lines(df: DataFrame, path: str, **options) -> None:
    """Lines to ISO-8859-1 files; the column's name is the header."""
    writer = df.write.option("header", True).option("encoding", "ISO-8859-1")
    writer = writer.option("sep", "\u0001").option("quote", "\u0000")
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer = writer.option("ignoreTrailingWhiteSpace", False)
    if "partition" in options:
        writer = writer.partitionBy(options["partition"])
    writer.csv(path)


# ---------------------------------------------------------------- granules

RECORD_HEADER = (
    "<pre>[Congressional Record Volume 141, Number 1 (Wednesday, January 4, 1995)]\n[House]\n"
    "[Pages H1-H5]\nFrom the Congressional Record Online through the Government Publishing "
    "Office [www.gpo.gov]\n\n</pre>"
)


def granules(spark: SparkSession, folder: str) -> DataFrame:
    """Landed granules from the pages; ids, metadata and defects follow from
    the page number."""
    pages = spread(table(spark, folder, "pages"), "page_id")
    p = F.col("page_id")
    text = p.cast("string")
    package = F.concat(
        F.lit("CREC-"), (1995 + p % 25).cast("string"), F.lit("-0"), (1 + p % 9).cast("string"),
        F.lit("-1"), (p % 10).cast("string"),
    )
    chamber = (
        F.when(p % 5 == 1, "S").when(p % 5 == 2, "E").when(p % 5 == 3, "D").otherwise("H")
    )
    matter = F.when(p % 17 == 0, "-FrontMatter").otherwise("")
    name = F.when(p % 2 == 0, F.concat(F.lit("Last"), text, F.lit(", First"))).otherwise(
        F.concat(F.lit("First Last"), text)
    )
    name = F.when(p % 5 == 1, F.concat(F.lit('["'), name, F.lit('"]'))).otherwise(name)
    party = F.when(p % 4 == 0, "D").when(p % 4 == 1, "R").when(p % 4 == 3, '{"name":"I"}')
    member = F.struct(
        name.alias("name"),
        party.alias("party"),
        F.concat(F.lit("S"), (p % 50).cast("string")).alias("state"),
        F.concat(F.lit("A"), F.lpad(text, 6, "0")).alias("bioguideId"),
    )
    summary = F.struct(
        F.when(p % 31 != 0, F.concat(F.lit("text/"), text)).alias("txt_link"),
        F.when(p % 8 != 0, (90 + p % 13).cast("string")).alias("congress"),
        F.when(p % 3 != 0, F.array(member)).otherwise(F.array()).alias("members"),
    )
    opening = F.when((p % 3 == 0) & (p % 2 == 0), "Mr. SMITH of Texas. ").otherwise("")
    header = F.when(p % 7 == 2, RECORD_HEADER).otherwise("")
    html = (
        F.when(p % 23 == 0, None)
        .when(p % 19 == 0, "<html><body>[House] Page 5 ok</body></html>")
        .otherwise(F.concat(header, opening, "html"))
    )
    return conform(
        pages.select(
            package.alias("package_id"),
            F.when(p % 4 == 0, "Unknown")
            .otherwise((104 + p % 13).cast("string"))
            .alias("package_congress"),
            F.concat(package, F.lit("-pt1-Pg"), chamber, text, matter).alias("granule_id"),
            F.when(p % 29 != 0, summary).alias("summary"),
            html.alias("html"),
            p.alias("arrival_seq"),
            "url",
            "page_id",
        ),
        GRANULES,
    )


def granule_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Page addresses by granule number."""
    return table(spark, folder, "pages").select(F.col("page_id").alias("arrival_seq"), "url")
