"""Run a registered query beside its SQL and compare rows regardless of order.

``python tests/compare.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ROOT = "/root/testdata"


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{ROOT}/{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, connection, sql: str) -> tuple[int, list, list]:
    """Row count and up to three rows that only one side has."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    found = rows_of(df.columns, [tuple(row) for row in df.collect()])
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    return sum(found.values()), list((found - expected).items())[:3], list((expected - found).items())[:3]


def main() -> None:
    from docketflow.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    wanted = sys.argv[2:]
    spark = local_session(8, 8, "12g")
    queries, oracles = entry.queries(), entry.oracle_sql()
    connection = oracle_connection(sf)
    bad = 0
    for name, run in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, f"{ROOT}/{sf}")
            if name in oracles:
                count, extra, missing = compare(df, connection, oracles[name])
                ok = not extra and not missing
                note = "" if ok else f"\n   only spark: {extra}\n   only sql:   {missing}"
            else:
                count, ok, note = df.count(), True, " (rows only)"
        except Exception as error:  # noqa: BLE001
            count, ok, note = -1, False, f" {type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} rows={count:7d} {time.time() - start:6.2f}s{note}", flush=True)
    print(f"{bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()
