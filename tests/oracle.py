"""Comparison of a query with its SQL in DuckDB, values as text, floats to six digits."""

import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return None if v is None else str(v)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)


def rows_of_sql(con, statement):
    r = con.sql(statement)
    cols = sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    return cols, sorted((tuple(norm(x[i]) for i in at) for x in r.limit(10**9).fetchall()), key=str)
