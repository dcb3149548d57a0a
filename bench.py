"""Time the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query computes all its rows into a sink that drops them. It is run twice:
``queries`` has the second run, ``first_run`` the first, which also pays for
planning and code generation. One JSON line goes to standard output.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from speechloom.plans.catalog import QUERIES  # noqa: E402
from speechloom.session import local_session  # noqa: E402

HEADLINE = """
phrase_trend phrase_trend_all partisan_share any_phrase_trend session_party_pivot compare_phrases
polarized_sessions speech_gallery keyword_purge zero_shot_rule bigram_substantive
bigram_substantive_table intro_substantive quality_sample label_progress score_batch apply_labels
top_words top_words_strict vocab_counts tfidf_unigram tfidf_bigram tfidf_bigram_final
deep_clean_tfidf vocab_tfidf context_words context_words_all entity_tag entity_stats
session_join match_rate load_sessions replace_session upsert_speeches upsert_table
granule_speeches ingest_audit ingest_stream lexicon_summary table_profile
label_speeches train_classifier entity_table csv_round_trip clean_text html_to_text procedural_terms
lexicon_load lexicon_merge lexicon_files lexicon_hits session_read ingest_stream_json table_distincts
tfidf_unigram_repeated bigram_substantive_repeated top_words_by_role
""".split()


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"), partitions=cpus)
    names = sys.argv[1:] or HEADLINE
    first, second = {}, {}
    for name in names:
        first[name] = seconds(spark, name, folder)
        second[name] = seconds(spark, name, folder)
        print(f"{name:28s} {first[name]:8.3f} {second[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(second.values()), 3),
                "unit": "sec",
                "queries": second,
                "first_run": first,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
