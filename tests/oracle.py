"""Compares a query's rows with its SQL's on DuckDB."""

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6)
    return x if x is None or isinstance(x, (int, str, bool)) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(df, connection, sql):
    found = connection.execute(sql)
    want = rows([c[0] for c in found.description], found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(got[1])} rows, {len(want[1])} expected; {bad[:2]}" if bad or len(got[1]) != len(want[1]) else None
