"""Every registered query against its SQL, and the stability of its schema."""

from pathlib import Path

import pytest
from compare import differences, spark_rows, sql_connection, sql_rows

import __spark_entry__ as entry_module
from speechloom.plans.catalog import QUERIES
from speechloom.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return sql_connection(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, connection, name):
    got = spark_rows(QUERIES[name](spark, FOLDER))
    assert differences(got, sql_rows(connection, ORACLE[name])) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["year", "party", "party_name", "mention_count"]
    assert df.count() == 27


@pytest.mark.parametrize("missing", ["xxhash", "speechloom.llm.queries", "corpus_pipeline"])
def test_the_other_queries_are_there_without_the_optional_ones(missing):
    import subprocess
    import sys

    code = (
        f"import sys; sys.modules[{missing!r}] = None; sys.path.insert(0, {str(Path(entry_module.__file__).parent)!r});"
        " import __spark_entry__ as e; print(len(e.queries()), 'phrase_trend' in e.oracle_sql())"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= len(QUERIES) and out[1] == "True"
