"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, Decimal)):
        return f"{float(v) + 0.0:.9g}"
    return str(v)


def assert_same(query, sql: str, spark, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[n]) for n in names) for r in df.collect())
    c = connect(sf_dir).execute(sql)
    have = [d[0] for d in c.description]
    assert sorted(have) == names
    want = sorted(tuple(cell(r[have.index(n)]) for n in names) for r in c.fetchall())
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want) if a != b]
    assert not different, different[:3]
    return len(got)
