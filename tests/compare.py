"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import os

import duckdb
import numpy as np

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf=SF):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def normal(d):
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        if d[c].dtype.kind in "iufb":
            d[c] = d[c].astype(float)
        else:
            d[c] = d[c].map(lambda v: str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v))
    return d.sort_values(list(d.columns), kind="stable").reset_index(drop=True)


def same(spark_df, sql, con):
    a, b = normal(spark_df.toPandas()), normal(con.execute(sql).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f" and y.dtype.kind == "f":
            assert np.array_equal(x, y, equal_nan=True), c
        else:
            assert (x == y).all(), c
