"""Runs a query on Spark and its SQL on DuckDB and compares names and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, query, sql: str, con, sf_dir: str = SF) -> str:
    """What differs; empty if nothing does."""
    df = query(spark, sf_dir)
    got, cursor = rows(df.columns, df.collect()), con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows(names, cursor.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {[x for x in got if x not in want][:2]} {[x for x in want if x not in got][:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w and not all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9) for a, b in zip(g, w, strict=True))]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
