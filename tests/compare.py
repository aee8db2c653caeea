"""Spark rows against DuckDB rows of the same tables."""

import glob
import math
import os
import re

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows, ordered=False):
    order = sorted(columns)
    out = [str([plain(r[c]) for c in order]) for r in rows]
    return out if ordered else sorted(out)


def same_rows(df, con, sql: str) -> None:
    found = con.sql(sql)
    ordered = re.search(r"ORDER BY [^()]*$", sql.strip()) is not None  # a query of its own order
    assert sorted(df.columns) == sorted(found.columns)
    want = rows_of(found.columns, [dict(zip(found.columns, r)) for r in found.fetchall()], ordered)
    assert rows_of(df.columns, [r.asDict() for r in df.collect()], ordered) == want
