"""Compares a query's rows with DuckDB's, whatever their order."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if x != x else repr(round(x, 6) + 0.0)
    return None if x is None else str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in values)


def expected(sql, folder=DATA):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    got = con.execute(sql)
    names = [c[0] for c in con.description]
    return names, got.fetchall()


def check(df, sql, folder=DATA):
    names, want = expected(sql, folder)
    assert sorted(names) == sorted(df.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(names, want)
