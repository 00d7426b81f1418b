"""Rows of a query and of its SQL, in a form that can be compared."""

import math
import os

import duckdb


def tables(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        path = f"{sf_dir}/{t}"
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, str)):
        return v
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(_plain(r[i]) for i in order)) for r in rows)


def assert_same(df, sql, connection):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    told = connection.sql(sql)
    want = rows_of(told.columns, told.fetchall())
    assert sorted(df.columns) == sorted(told.columns)
    assert len(got) == len(want)
    assert got == want
