"""Comparing a Spark result with SQL on the same tables."""

import glob
import os

import duckdb


def connect(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


def compare(frame, c, sql):
    """Same column names, and the same rows in any order."""
    columns = sorted(frame.columns)
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(k) for k in columns]
    expected = [tuple(r[k] for k in at) for r in cursor.fetchall()]
    assert normal([tuple(r[k] for k in columns) for r in frame.collect()]) == normal(expected)
