"""Rows of a query beside those of its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return db


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def both(spark, db, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = db.execute(sql)
    return got, rows([d[0] for d in found.description], found.fetchall())
