"""Comparison of a Spark result with the SQL result, as multisets of rows."""

from __future__ import annotations

import math


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(v)


def rows_of_frame(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(con, sql: str):
    r = con.sql(sql)
    names = r.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_norm(row[i]) for i in order) for row in r.fetchall())


def check(queries: dict, oracles: dict, name: str, spark, data: str, duck) -> None:
    df = queries[name](spark, data)
    if name not in oracles:
        assert df.columns
        df.collect()
        return
    got, want = rows_of_frame(df), rows_of_sql(duck, oracles[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
