"""Delimited files: the raw session archives, CSV round trips, term lists."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions.text import strip_space
from speechloom.operators.sessions import build_speakers, join_session, standardize

_FILE_KINDS = {
    "speeches": ("*speeches_*.txt", r"speeches_(\d+)\.txt"),
    "descr": ("*descr_*.txt", r"descr_(\d+)\.txt"),
    "speaker_map": ("*_SpeakerMap.txt", r"(\d+)_SpeakerMap\.txt"),
}


def _archive(spark: SparkSession):
    # a separator that no text holds: each line is read as one column
    return (
        spark.read.option("sep", "\u0001\u0002\u0003")
        .option("encoding", "ISO-8859-1")
        .option("quote", "")
        .option("header", True)
        .option("recursiveFileLookup", True)
    )


def _headers(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """Files by their header line. One line of each file is read, here, where
    Spark, too, looks at files to find their columns; empty files have none."""
    jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()

    def header(file) -> str | None:
        stream = file.getFileSystem(settings).open(file)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "ISO-8859-1"))
        try:
            line = reader.readLine()
            while line is not None and not line.strip():
                line = reader.readLine()
            return line
        finally:
            reader.close()

    listed = spark.read.option("recursiveFileLookup", True).text(paths).inputFiles()
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)) for file in sorted(listed)]
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(header, files))
    groups: dict[str, list[str]] = {}
    for file, line in zip(files, found):
        if line is not None:
            groups.setdefault(line, []).append(file.toString())
    return groups


# What becomes of a line: it has a field for each column, lacks some, or has too many.
WHOLE, PADDED, DROPPED = "whole", "padded", "dropped"


def read_lines(
    spark: SparkSession, paths: str | list[str], session_pattern: str | None = None
) -> DataFrame:
    """Every line of pipe-delimited archive files: ``_file``, ``_outcome`` (whole,
    padded or dropped), ``_line`` (the text of a dropped one) and the columns of
    the others, as :func:`read_session` gives them."""

    def read(header: str, files: list[str]) -> DataFrame:
        names = header.split("|")
        columns = [F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(names)]
        if session_pattern:
            number = F.regexp_extract("_metadata.file_path", session_pattern, 1)
            columns.append(number.cast("int").alias("congress_session"))
        lines = _archive(spark).schema("line string").csv(files)
        split = lines.select("*", "_metadata", F.split("line", r"\|", -1).alias("fields"))
        outcome = (
            F.when(F.size("fields") > len(names), DROPPED)
            .when(F.size("fields") < len(names), PADDED)
            .otherwise(WHOLE)
        )
        found = split.select(
            F.col("_metadata.file_path").alias("_file"),
            outcome.alias("_outcome"),
            F.when(F.size("fields") > len(names), F.col("line")).alias("_line"),
            *columns,
        )
        no_value = [None] * len(fv.MISSING_MARKERS)
        return found.replace(fv.MISSING_MARKERS, no_value, names)

    groups = _headers(spark, paths)
    if not groups:
        raise ValueError(f"no file with a header line in {paths}")
    parts = [read(header, files) for header, files in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_session(
    spark: SparkSession, paths: str | list[str], session_pattern: str | None = None
) -> DataFrame:
    """Rows of pipe-delimited archive files, all columns as strings.

    Column names come from each file's own header line; a column that a file
    lacks is NULL in its rows. Quotes are ordinary characters. Lines with too
    many fields are dropped, short lines are padded with NULL, and the usual
    markers for a missing value read as NULL. With ``session_pattern`` the file
    name gives a ``congress_session`` column.
    """
    lines = read_lines(spark, paths, session_pattern)
    return lines.where(F.col("_outcome") != DROPPED).drop("_file", "_outcome", "_line")


def keep_lines(lines: DataFrame, path: str) -> dict[str, int]:
    """Write what :func:`read_lines` gave, rows and dropped lines in folders of their own
    by outcome, and count the outcomes, all in one pass over the files."""
    counts = Observation()
    seen = [F.count_if(F.col("_outcome") == o).alias(o) for o in (WHOLE, PADDED, DROPPED)]
    lines.observe(counts, *seen).write.partitionBy("_outcome").parquet(path)
    return counts.get


def line_account(lines: DataFrame, by: str = "_file") -> DataFrame:
    """Lines by outcome, and the characters that were dropped, per file or session."""
    return lines.groupBy(by).agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("_outcome") == PADDED).alias("n_padded"),
        F.count_if(F.col("_outcome") == DROPPED).alias("n_dropped"),
        F.coalesce(F.sum(F.length("_line")), F.lit(0)).alias("dropped_chars"),
    )


def load_sessions(
    spark: SparkSession,
    root: str,
    first: int | None = None,
    last: int | None = None,
) -> DataFrame:
    """All sessions of an archive folder, or those from ``first`` to ``last``, as
    one production-format table.

    A session is loaded only if each of its three files is there. Every file is
    read once; files of a kind are read together if their headers agree.
    """
    frames, numbers = {}, []
    for kind, (glob, pattern) in _FILE_KINDS.items():
        frames[kind] = read_session(spark, f"{root}/{glob}", pattern)
        found = [re.search(pattern, path) for path in frames[kind].inputFiles()]
        numbers.append({int(match[1]) for match in found if match})
    complete = {
        n
        for n in set.intersection(*numbers)
        if (first is None or n >= first) and (last is None or n <= last)
    }
    speeches = frames["speeches"].where(F.col("congress_session").isin(sorted(complete)))
    keys = ["congress_session", "speech_id"]
    merged = join_session(speeches, frames["descr"], frames["speaker_map"], keys)
    typed = merged.withColumns(
        {
            "date": F.col("date").try_cast("int"),
            "speakerid": F.col("speakerid").try_cast("double").cast("bigint"),
        }
    )
    return standardize(build_speakers(typed, F.col("congress_session")))


# -------------------------------------------------------------------- CSV


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """CSV with a header. Texts hold line breaks, so a reader cannot split a
    file; the row limit per file keeps the files small enough to read in parallel."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read what :func:`write_csv` wrote; empty strings come back as NULL."""
    df = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("lineSep", "\n")
        .schema(schema)
        .csv(path)
    )
    return df.select(
        *[
            F.nullif(F.col(n), F.lit("")).alias(n) if t == "string" else F.col(n)
            for n, t in df.dtypes
        ]
    )


# ------------------------------------------------------------- term lists


def read_term_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a term file; bytes that are not UTF-8 become U+FFFD."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def procedural_terms(lines: DataFrame, column: str = "line") -> DataFrame:
    """Distinct terms from the first ``|`` field of each line, stripped and in
    lower case. A header line counts as a term like any other."""
    term = F.lower(strip_space(F.split_part(column, F.lit("|"), F.lit(1))))
    return lines.select(term.alias("term")).where(F.col("term") != "").distinct()
