"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def cell(x) -> str:
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(df) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def collected(df) -> pd.DataFrame:
    """The rows with whole numbers as such, also where a column has nulls."""
    whole = {c: "Int64" for c, kind in df.dtypes if kind in ("bigint", "int")}
    return df.toPandas().astype(whole)


def assert_same(spark, sf_dir: str, query, sql: str) -> None:
    ours = collected(query(spark, sf_dir))
    theirs = connection(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
