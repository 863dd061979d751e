"""Rows of a query and of its SQL in DuckDB, in a form that can be compared."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    return db


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(df) -> Counter:
    order = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in order) for r in df.select(*order).collect())


def rows_of_sql(db, sql: str) -> tuple[list[str], Counter]:
    got = db.sql(sql)
    names = list(got.columns)
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, Counter(tuple(plain(r[k]) for k in at) for r in got.fetchall())


def differences(df, db, sql: str) -> str:
    names, want = rows_of_sql(db, sql)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {names}"
    got = rows_of(df)
    if got == want:
        return ""
    return f"{sum((got - want).values())} of {sum(got.values())} rows are extra, {sum((want - got).values())} of {sum(want.values())} missing: {list((got - want))[:3]} {list((want - got))[:3]}"
