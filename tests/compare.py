"""Comparison of a query's rows with DuckDB's, by sorted columns and regardless of order."""

import glob
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name, files = os.path.basename(p)[:-8], f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {name} as select * from read_parquet('{files}')")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and x != x:
        return ""
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = rows([c[0] for c in result.description], result.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
