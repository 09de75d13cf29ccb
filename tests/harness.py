"""Compares a query with its SQL in DuckDB on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def differences(spark, con, sf_dir, query, sql):
    """What differs between the two results, as text; empty if nothing does."""
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = sorted(got.columns)
    columns = [d[0] for d in want.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    place = [columns.index(n) for n in names]
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    odd = [(x, y) for x, y in zip(a, b, strict=True) if repr(x) != repr(y)]
    return f"{len(odd)} rows differ, first {odd[0]}" if odd else ""
