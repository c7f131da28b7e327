"""Comparison of Spark rows with DuckDB rows, whatever their order."""

from __future__ import annotations

import decimal
import math


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else ("f", round(float(v), 6))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    return str(v)


def same(df, con, sql: str) -> None:
    cur = con.execute(sql)
    columns = [x[0] for x in cur.description]
    order = sorted(columns)
    assert order == sorted(df.columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == want
