"""Run a registered query and its oracle side by side and compare values."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    return str(v)


def sort_key(row):
    return tuple((v is not None, str(type(v)), f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b):
    """Equal as values; floats to the last bit but for a representation slack."""
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return a == b
    return a == b and type(a) is type(b)


def compare(spark, sf_dir, fn, sql, con=None, allow_empty=False):
    """Return (ok, message)."""
    con = con or connect(sf_dir)
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in got_cols) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols = sorted(cols)
    at = [cols.index(c) for c in want_cols]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    t2 = time.time()
    took = f"spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s rows {len(got)}"
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols} {took}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)} {took}"
    if not got and not allow_empty:
        return False, f"empty {took}"
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    for g, w in zip(got, want):
        if not all(same(a, b) for a, b in zip(g, w)):
            return False, f"{got_cols}: {g} vs {w} {took}"
    return True, took
