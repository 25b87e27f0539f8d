"""Holding a query's rows against SQL: equal column names, equal multisets of rows, floats to 6 digits."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    if x is None:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def database(folder: str):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def difference(df, database, sql: str) -> str:
    """What differs between a DataFrame and the SQL's result; empty if nothing does."""
    want = database.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(want.columns, want.fetchall())
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}"
    return ""
