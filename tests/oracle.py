"""Compares a query's rows with its SQL on the same tables."""

import math
import os

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())
    assert got == want
