"""Compares a Spark result with DuckDB's on the same tables, as bags of rows."""

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def check(spark_df, sql, sf_dir):
    columns, rows = oracle(sql, sf_dir)
    assert sorted(columns) == sorted(spark_df.columns)
    mine = bag(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = bag(columns, rows)
    assert len(mine) == len(theirs)
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not different, different[:3]
    return len(mine)
