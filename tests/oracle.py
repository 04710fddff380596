"""Runs a query's SQL in DuckDB over the same tables, and compares values whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if not isinstance(x, (int, bool, type(None))) else x


def assert_same(df, sql: str, sf_dir: str):
    names, want = rows_of(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(repr([_plain(r[c]) for c in order]) for r in df.collect())
    at = {c: i for i, c in enumerate(names)}
    assert got == sorted(repr([_plain(r[at[c]]) for c in order]) for r in want)
