"""Run a query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
from riskframe.plans.catalog import TABLES


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else (str(int(f)) if f == int(f) else f"{f:.6g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def duck(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """(ok, message). Same columns, same bag of rows."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return False, f"rows {len(got)} vs {len(want)}; only spark {sorted(a)[:3]}; only sql {sorted(b)[:3]}"
    return True, f"{len(got)} rows"
