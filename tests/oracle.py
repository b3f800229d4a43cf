"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(x):
    if isinstance(x, float):
        return 0.0 if x == 0 else float(f"{x:.9g}")
    return tuple(map(_plain, x)) if isinstance(x, (list, tuple)) else x


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> str:
    """Empty if both agree, else what differs."""
    found = con.sql(sql)
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} and {sorted(found.columns)}"
    a, b = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only in Spark: {list((a - b).items())[:3]}; only in SQL: {list((b - a).items())[:3]}"
    kinds = dict(df.dtypes)
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = {c: (kinds[c], str(t)) for c, t in zip(found.columns, found.types, strict=True) if names.get(kinds[c], kinds[c]) != str(t)}
    return f"types {odd}" if odd else ""
