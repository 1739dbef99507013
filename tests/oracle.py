"""Compares a query with its DuckDB oracle."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        path = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(columns, rows):
    return sorted((tuple(_plain(x) for x in r) for r in rows), key=repr)


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = rows_of(columns, df.select(*columns).collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = rows_of(columns, ([r[i] for i in places] for r in result.fetchall()))
    assert got == want
