"""Runs a query on Spark and its SQL on DuckDB over the same files and compares the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("WEFTLINE_TEST_DATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return tuple(_cell(v) for v in x) if isinstance(x, (list, tuple)) else x


def differences(spark, run, sql: str, sf_dir: str, con: duckdb.DuckDBPyConnection | None = None) -> list[str]:
    """What differs, in words; empty if nothing does."""
    df = run(spark, sf_dir)
    cur = (con or connect(sf_dir)).execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    want = Counter(tuple(_cell(r[names.index(c)]) for c in order) for r in cur.fetchall())
    got = Counter(tuple(_cell(r[c]) for c in order) for r in df.collect())
    if got == want:
        return []
    return [f"{sum(got.values())} and {sum(want.values())} rows", f"only Spark: {list((got - want).items())[:3]}", f"only SQL: {list((want - got).items())[:3]}"]
