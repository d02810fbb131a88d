"""Compares a query with its DuckDB oracle, order aside."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)


def rows_of_duckdb(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    made = con.sql(sql)
    at = sorted(range(len(made.columns)), key=lambda i: made.columns[i])
    return [made.columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in made.fetchall()), key=str)
