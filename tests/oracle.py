"""Comparing a Spark result with DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def both(df, sql, sf_dir):
    """The sorted rows of either side, columns in name order."""
    cols = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    got = connect(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted(([plain(r[names.index(c)]) for c in cols] for r in got.fetchall()), key=repr)
    return ours, theirs
