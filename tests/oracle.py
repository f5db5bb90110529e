"""Compares a query's rows with DuckDB's, the way the driver does: columns by name, rows in any order."""

import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(f"{float(v):.10g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def duck(sf: str, sql: str):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def assert_same(df, sf: str, sql: str):
    names, want = duck(sf, sql)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    assert got == want
