"""Comparison of a query with its SQL in DuckDB over the same Parquet tables."""

from __future__ import annotations

import datetime
import glob
import math
import os


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return str(value)


def canon(rows, columns):
    """Rows in an order of their own, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def differences(df, con, sql: str) -> tuple[int, int, list, list]:
    """Numbers of rows, and rows that only one side has."""
    rows = [tuple(r) for r in df.collect()]
    result = con.sql(sql)
    columns, want = list(result.columns), result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return len(rows), len(want), sorted(df.columns), sorted(columns)
    got, expected = canon(rows, df.columns), canon(want, columns)
    if got == expected:
        return len(rows), len(want), [], []
    a, b = set(got), set(expected)
    return len(rows), len(want), sorted(a - b)[:5] or got[:5], sorted(b - a)[:5] or expected[:5]
