"""Comparing a Spark result with DuckDB's, whatever the order of rows and columns."""

import decimal
import math
import os

import duckdb


def views(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(d):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    return c


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    return str(v)


def rows(df) -> tuple[list[str], list]:
    cols = sorted(df.columns)
    return cols, sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())


def duck_rows(c, sql: str, cols: list[str]) -> list:
    r = c.execute(sql)
    at = [x[0] for x in r.description]
    return sorted(tuple(canon(x[at.index(n)]) for n in cols) for x in r.fetchall())
