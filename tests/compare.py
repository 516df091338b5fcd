"""Rows of a Spark query and of its SQL in a comparable form."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ").replace(" 00:00:00", "")
    return float(v)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)


def sql_rows(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(n) for n in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
