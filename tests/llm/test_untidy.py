"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names: every operator and every pipeline stage has a result."""

import pytest
from llm_data import messy_documents, with_clashes

import corpus_pipeline
from speechloom.llm import (
    decontamination,
    license_scan,
    mixing,
    quality_ranking,
    quality_rules,
    quotation,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
)

BENCHMARK = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def benchmark_table(spark):
    rows = [(1, "word1 word2 word3 word4 word5 word6"), (None, None), (2, ""), (1, "word9"), (3, "lorem ipsum dolor sit amet lorem")]
    return spark.createDataFrame(rows, BENCHMARK)


@pytest.fixture(scope="module")
def label_table(spark):
    rows = [(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(40)]
    rows += [(None, 1, 0), (1, None, None), (2, 0, 1), (2, 1, 0), (3, 7, 9), (999, 1, 1)]
    return spark.createDataFrame(rows, LABELS)


def per_document(spark, labels, benchmark):
    return {
        "mix": lambda d: mixing.mixed(d, block=16),
        "suffixes": lambda d: suffix_dedup.remove_repeats(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "toxicity": lambda d: toxicity.scored(d, labels),
        "ranking": lambda d: quality_ranking.scored(d, labels),
        "rules": lambda d: quality_rules.assess(d),
    }


@pytest.mark.parametrize("name", ["mix", "suffixes", "simhash", "toxicity", "ranking", "rules"])
def test_one_row_per_document_whatever_it_holds(spark, label_table, benchmark_table, name):
    operator = per_document(spark, label_table, benchmark_table)[name]
    docs = messy_documents(spark)
    plain = operator(docs)
    got = sorted((tuple(r) for r in plain.select(*sorted(set(plain.columns) - {"lang", "source", "n_chars", "taken"})).collect()), key=str)
    assert len(got) == docs.count()
    assert sorted(map(str, (r.doc_id for r in plain.collect()))) == sorted(map(str, (r.doc_id for r in docs.collect())))
    clashing = operator(with_clashes(docs))
    again = sorted((tuple(r) for r in clashing.select(*sorted(set(plain.columns) - {"lang", "source", "n_chars", "taken"})).collect()), key=str)
    assert again == got
    empty = operator(docs.limit(0))
    assert empty.collect() == [] and empty.columns == plain.columns


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns(spark, tmp_path, benchmark_table, name):
    benchmark_table.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = messy_documents(spark)
    for table in (docs, with_clashes(docs), docs.limit(0)):
        out = stage(spark, table, str(tmp_path))
        rows = out.collect()
        assert len(rows) <= table.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == table.columns
            assert [t for _, t in out.dtypes] == [t for _, t in table.dtypes]


def test_stages_that_leave_texts_alone_return_rows_of_the_table(spark, tmp_path, benchmark_table):
    benchmark_table.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = with_clashes(messy_documents(spark))
    own = {str(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        if name != "suffix-array dedup":
            assert {str(r) for r in stage(spark, docs, str(tmp_path)).collect()} <= own


def test_leaks_and_licences(spark, benchmark_table):
    docs = with_clashes(messy_documents(spark))
    found = decontamination.leaks(docs, benchmark_table).collect()
    assert {r.item_id for r in found if r.doc_id in (103, 104)} >= {3}
    assert all(0.8 <= r.coverage <= 1 for r in found)
    assert decontamination.leaks(docs.limit(0), benchmark_table).collect() == []
    assert decontamination.leaks(docs, benchmark_table.limit(0)).collect() == []
    assert decontamination.keep_clean(docs, benchmark_table.limit(0)).count() == docs.count()
    assert license_scan.scanned(docs).where("confirmed").collect() == []
    assert license_scan.scanned(docs.limit(0)).collect() == []


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.ORG", "http://a.org/", "://", "ftp://u.com/fr/", "a://b://c/d", "http://x.com/" + "s/" * 500]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(None, "http://a.org/x"), (4, "http://a.org/")], "page_id long, url string")
    rows = url_filter.judged(with_clashes(pages)).collect()
    assert len(rows) == 11
    by = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in rows}
    assert by[0, "", ""] == by[1, "", ""] == by[2, "", ""] == (None, "allow")
    assert by[3, "a.org", ""] == (None, "allow")
    assert by[4, "a.org", "/"] == ("org/", "allow")
    assert by[6, "u.com", "/fr/"] == ("com/fr/", "allow")
    assert by[7, "b:", "//c/d"][0] is None
    assert url_filter.judged(pages.limit(0)).collect() == []


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "u", "x"), (3, None, "u", "> x\ny"), (3, 1, None, None), (4, 0, "u", ""), (4, 0, "u", "")]
    messages = with_clashes(spark.createDataFrame(rows, schema))
    got = quotation.formatted(messages).collect()
    assert len(got) == 5 and all(r.depth == 0 and r.reply_to is None for r in got)
    assert quotation.formatted(messages.limit(0)).collect() == []
