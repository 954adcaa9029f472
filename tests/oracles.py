"""Comparing a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(path=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 7) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(spark, query, sql, path=DATA):
    df = query(spark, path)
    cursor = connect(path).execute(sql)
    expected = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected
