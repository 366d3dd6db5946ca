"""Runs a registered query and its SQL on the same tables and compares them as bags of rows."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def _same(p, q) -> bool:
    return p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-9 * max(1, abs(p))


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    # floats last: where they differ in the last digit, rows that agree in all else still meet
    made = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(made, key=lambda t: (repr([x for x in t if not isinstance(x, float)]), repr(t)))


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' where both agree."""
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, told.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    far = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(_same, x, y))]
    return f"{len(far)} rows differ: {far[:2]}" if far else ""
