"""Compares a DataFrame with what DuckDB gives for SQL on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


def same(df, sql, folder):
    rel = connect(folder).sql(sql)
    names = list(rel.columns)
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, df.collect()), rows(names, rel.fetchall())
    assert a == b, (len(a), len(b), sorted(set(a) - set(b), key=str)[:3], sorted(set(b) - set(a), key=str)[:3])
    return len(a)
