"""Compare a query's rows with its SQL run by DuckDB on the same files."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, list | tuple):
        return tuple(_cell(v) for v in value)
    return str(value) if hasattr(value, "isoformat") else value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str, show: int = 3) -> list[str]:
    """What is wrong, or an empty list."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(sql)
    columns = [c[0] for c in answer.description]
    theirs = rows_of(columns, answer.fetchall())
    found = []
    if sorted(df.columns) != sorted(columns):
        found.append(f"columns {sorted(df.columns)} against {sorted(columns)}")
    extra, missing = mine - theirs, theirs - mine
    if extra or missing:
        found.append(f"{sum(mine.values())} rows against {sum(theirs.values())}")
        found += [f"only here: {str(r)[:600]}" for r in sorted(extra, key=str)[:show]]
        found += [f"only there: {str(r)[:600]}" for r in sorted(missing, key=str)[:show]]
    return found
