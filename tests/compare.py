"""Comparing a Spark result with a DuckDB result, whatever the order of rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        try:
            return f"{float(x):.9f}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(value(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def same(got: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(wanted.columns)
    assert len(got) == len(wanted)
    differ = [(a, b) for a, b in zip(plain(got), plain(wanted)) if a != b]
    assert not differ, differ[:3]
