"""Compares a query with its SQL in DuckDB, by sorted rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
        return "null"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


def check(spark, sf, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(query(spark, sf).toPandas()) == rows(con.execute(sql).df())
