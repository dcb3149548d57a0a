"""Schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

SPEECHES = T.StructType(
    [
        T.StructField("speech_id", T.StringType()),
        T.StructField("speech", T.StringType()),
        T.StructField("date", T.IntegerType()),
        T.StructField("speakerid", T.LongType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("is_mapped", T.IntegerType()),
        T.StructField("party", T.StringType()),
        T.StructField("state_x", T.StringType()),
        T.StructField("lastname", T.StringType()),
        T.StructField("firstname", T.StringType()),
        T.StructField("congress_session", T.IntegerType()),
        T.StructField("is_procedure", T.IntegerType()),
    ]
)

# Member values may be plain text or raw JSON text (list or object): the JSON
# reader hands nested values over as their source text when the field is a string.
MEMBER = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("party", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("bioguideId", T.StringType()),
    ]
)

# One landed granule: summary is NULL when its metadata could not be fetched,
# txt_link when it names no text, html when the text itself is missing.
GRANULES = T.StructType(
    [
        T.StructField("package_id", T.StringType()),
        T.StructField("package_congress", T.StringType()),
        T.StructField("granule_id", T.StringType()),
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("txt_link", T.StringType()),
                    T.StructField("congress", T.StringType()),
                    T.StructField("members", T.ArrayType(MEMBER)),
                ]
            ),
        ),
        T.StructField("html", T.StringType()),
        T.StructField("arrival_seq", T.LongType()),
    ]
)

POLICY_ENTRY = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("historical_terms", T.ArrayType(T.StringType())),
    ]
)

FILTER_CONFIG = T.StructType(
    [
        T.StructField("policy_bridge", T.MapType(T.StringType(), POLICY_ENTRY)),
        # lists as their JSON text: an entry that is no list must not spoil the others
        T.StructField("denoising_lexicon", T.MapType(T.StringType(), T.StringType())),
    ]
)

SCORES = "speech_id string, top_label string, score double"


def conform(df, schema: T.StructType = SPEECHES):
    """Cast and order columns to a schema; absent columns become NULL."""
    from pyspark.sql import functions as F

    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
