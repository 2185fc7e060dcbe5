"""Compare registered queries with their SQL: python -m workload.check [sf_dir] [name part ...]"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

import workload
from workload.registry import QUERIES, SQL


def duckdb_over(sf_dir: str):
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """'' when both results are the same, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got_columns, got = rows_of(df.columns, df.collect())
    if name not in SQL:
        return "" if got else "no rows"
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    want_columns, want = rows_of(columns, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if not want:
        return "expected result has no rows"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows, expected {len(want)}\n   got  {only_got}\n   want {only_want}"
    return ""


def main() -> None:
    from tests.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    workload.load()
    spark = local_session(8)
    con = duckdb_over(sf_dir)
    failures = 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failures += bool(problem)
        mark = "FAIL" if problem else "ok" if name in SQL else "rows"
        print(f"{mark:5}{time.time() - start:7.2f}s {name} {problem}", flush=True)
    print(f"{failures} failed")


if __name__ == "__main__":
    main()
