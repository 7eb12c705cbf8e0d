"""Compares a query with its SQL on the same tables, column by column, in any order of rows."""

import math
import os

import duckdb
import pandas as pd


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return f"{float(v) + 0.0:.9g}"
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df[names].itertuples(index=False))


def assert_same(spark, name, run, sql, sf_dir):
    got, want = rows(run(spark, str(sf_dir)).toPandas()), rows(views(str(sf_dir)).sql(sql).df())
    assert got[0] == want[0], name
    assert len(got[1]) == len(want[1]), name
    assert got[1] == want[1], name
