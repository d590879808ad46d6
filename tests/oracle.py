"""Runs a query and its SQL twin on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(v: object) -> str:
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def assert_same(df, sql: str, c: duckdb.DuckDBPyConnection) -> None:
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    r = c.sql(sql)
    assert sorted(r.columns) == names
    at = [r.columns.index(n) for n in names]
    assert got == sorted(tuple(_plain(row[i]) for i in at) for row in r.fetchall())
