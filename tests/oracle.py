"""Comparison of queries with their SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

DATA = os.environ.get("STEPWEAVE_TESTDATA", "/root/testdata/sf0.001")


def _cell(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "~"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def _rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def connect() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def compare(spark, query, sql: str) -> None:
    got, want = query(spark, DATA).toPandas(), connect().sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
