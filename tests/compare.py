"""Rows of a query and of its SQL in one comparable form."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(path: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    return c


def form(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(form, v)) + "]"
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(form(r[n]) for n in names) for r in df.collect())


def rows_of_sql(connection, sql):
    r = connection.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(n) for n in names]
    return names, sorted(tuple(form(x[i]) for i in at) for x in r.fetchall())
