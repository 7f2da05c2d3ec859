"""Compare a query with its SQL: row count, column names and kinds, and all values."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, Decimal):
        return float(v)
    return v


def kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    return "float" if isinstance(v, float) else type(v).__name__


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    values = [tuple(cell(r[i]) for i in order) for r in rows]
    return names, sorted(values, key=lambda r: tuple((v is not None, str(v)) for v in r))


def expected(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def actual(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def differences(got, want) -> list[str]:
    if got[0] != want[0]:
        return [f"columns {got[0]} != {want[0]}"]
    if len(got[1]) != len(want[1]):
        return [f"rows {len(got[1])} != {len(want[1])}"]
    out = []
    for g, w in zip(got[1], want[1]):
        if g != w or [kind(x) for x in g if x is not None] != [kind(x) for x in w if x is not None]:
            out.append(f"{dict(zip(got[0], g))} != {dict(zip(got[0], w))}")
    return out
