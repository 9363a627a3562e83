"""Spark's answer against DuckDB's, column by column by name, rows in any order."""

import os

import duckdb


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool | str | bytes):
        return v
    return round(float(v), 6)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False)), key=repr)


def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            path = f"{sf}/{f}"
            con.execute(f"create view {f[:-8]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def same(spark, sf, f, sql):
    got, want = rows(f(spark, sf).toPandas()), rows(duck(sf).execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
