"""Queries of the folder against their SQL."""

import pytest
from compare import differences, spark_rows, sql_connection, sql_rows

from speechloom.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    got = spark_rows(QUERIES[name](spark, FOLDER))
    assert differences(got, sql_rows(sql_connection(FOLDER), ORACLE[name])) is None
