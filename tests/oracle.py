"""Compares a query with its SQL in DuckDB."""

import datetime
import math
import os


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return v.isoformat()
    if hasattr(v, "quantize"):
        return float(v)
    return v


def compare(spark, root, query, sql):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(root):
        con.execute(f"create view {f.split('.')[0]} as select * from '{root}/{f}'")
    df = query(spark, root)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(normal(r[c]) for c in cols)) for r in df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = sorted(repr(tuple(normal(dict(zip(names, r))[c]) for c in cols)) for r in got.fetchall())
    assert sorted(names) == cols
    assert ours == theirs
