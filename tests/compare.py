"""Rows of Spark and DuckDB side by side."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v: object) -> object:
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v) if not isinstance(v, (int, bool, str)) else v


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(spark, con, query, sql: str, folder: str = DATA) -> None:
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())
