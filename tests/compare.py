"""Comparing a query's rows with its SQL's, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def connect(data: Path = DATA):
    import duckdb

    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, values) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


def differences(df, con, sql: str) -> tuple[list, list]:
    """Rows that only one side has."""
    got = rows(df.columns, df.collect())
    relation = con.sql(sql)
    want = rows(relation.columns, relation.fetchall())
    assert sorted(df.columns) == sorted(relation.columns)
    return list((got - want).items())[:3], list((want - got).items())[:3]
