"""Query results held against SQL: same columns, same rows in any order."""

import math
import os

import duckdb

DATA = "/root/testdata"


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        con.execute(f"create view {name.split('.')[0]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 9) + 0.0) if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    got = con.execute(sql)
    return rows_of([c[0] for c in got.description], got.fetchall())
