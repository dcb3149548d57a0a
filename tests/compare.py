"""Run registered queries and their SQL side by side.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _sorted(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(r[i] for i in order) for r in values]
    return [names[i] for i in order], sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def spark_rows(df):
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, text):
    result = connection.execute(text)
    return _sorted([d[0] for d in result.description], result.fetchall())


def differences(spark, oracle) -> str | None:
    if spark[0] != oracle[0]:
        return f"columns {spark[0]} / {oracle[0]}"
    if len(spark[1]) != len(oracle[1]):
        return f"rows {len(spark[1])} / {len(oracle[1])}"
    for a, b in zip(spark[1], oracle[1]):
        for name, x, y in zip(spark[0], a, b):
            if x != y or (type(x) is not type(y)):
                return f"{name}: {str(x)[:200]!r} {type(x).__name__} / {str(y)[:200]!r} {type(y).__name__} in {str(a)[:200]}"
    return None


def main() -> None:
    from speechloom.plans.catalog import QUERIES
    from speechloom.plans.oracle import ORACLE
    from speechloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, connection = local_session(8), sql_connection(folder)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            got = spark_rows(QUERIES[name](spark, folder))
            middle = time.time()
            result = (
                differences(got, sql_rows(connection, ORACLE[name])) if name in ORACLE else "no SQL"
            )
        except Exception as error:  # report and go on
            middle, got, result = time.time(), ([], []), f"{type(error).__name__} {str(error)[:600]}"
        bad += result not in (None, "no SQL")
        print(
            f"{name:26s} {len(got[1]):7d} rows {middle - start:6.2f}s  sql {time.time() - middle:6.2f}s "
            f" {result or 'equal'}",
            flush=True,
        )
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
