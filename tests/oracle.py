"""Runs the registered SQL in DuckDB and compares whole results by value."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.itertuples(index=False)), key=repr)


def differences(spark_frame, con, sql: str) -> str:
    """Empty if equal."""
    got, want = spark_frame.toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    other = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    return f"{len(a)} rows against {len(b)}; first differing: {other[:3]}"
