"""A query's rows against its SQL's, in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(df) -> tuple[list[str], list[tuple]]:
    """Column names, sorted, and sorted rows."""
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)


def sql_rows(sql: str, names: list[str], folder: str = DATA) -> list[tuple]:
    """Sorted rows of the SQL over the folder's tables."""
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    found = con.execute(sql)
    at = [[d[0] for d in found.description].index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
