"""Spark results against SQL on the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (int, bool, str, type(None))) else str(v)


def rows_of(rows, columns: list[str], order: list[str]) -> list[tuple]:
    at = [columns.index(c) for c in order]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=str)


def assert_same(df, con, sql: str) -> None:
    rel = con.sql(sql)
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    assert rows_of([tuple(r) for r in df.collect()], df.columns, order) == rows_of(rel.fetchall(), rel.columns, order)
