"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    out = [tuple(_cell(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v).__name__), v if v is not None else 0) for v in r))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    a, b = rows(spark_frame), rows(sql_frame)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first: {wrong[0]}"
    types = [(c, str(spark_frame[c].dtype), str(sql_frame[c].dtype)) for c in spark_frame.columns
             if str(spark_frame[c].dtype) != str(sql_frame[c].dtype) and len(spark_frame)]
    return f"types {types}" if types else None
