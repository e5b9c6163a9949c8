"""A query's rows against the rows of its SQL in DuckDB."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = frame.astype(object).where(frame.notna(), None).values.tolist()
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in plain)


def compare(spark, con, sf_dir, query, sql):
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
