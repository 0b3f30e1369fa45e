"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, int) and not isinstance(x, bool):
        return x
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differ(df, con, sql: str) -> str | None:
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b = rows([x[0] for x in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} {len(b[1])}; first {a[1][:1]} {b[1][:1]}"
    for x, y in zip(a[1], b[1], strict=True):
        if repr(x) != repr(y):
            return f"{x} != {y}"
    return None
