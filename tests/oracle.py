"""Comparing a Spark result with DuckDB's on the same tables."""

import math
import os

import duckdb


def connect(d):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(d):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def rows(table):
    t = table.select(sorted(table.column_names))
    return t.column_names, sorted(tuple(map(norm, r.values())) for r in t.to_pylist())


def same(spark_df, con, sql):
    got = rows(spark_df.toArrow())
    rel = con.sql(sql)
    t = rel.arrow()
    want = rows(t if hasattr(t, "column_names") else t.read_all())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
