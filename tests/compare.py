"""Compare registered queries with their SQL on one data folder (order-insensitive)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def check(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"{name}: columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows vs {len(want)}\n  spark {got[:2]}\n  sql   {want[:2]}"
    for g, x in zip(got, want):
        if g != x:
            return f"{name}: {sorted(cols)}\n  spark {g}\n  sql   {x}"
    if not got:
        return f"{name}: no rows on either side"
    return None
