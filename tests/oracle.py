"""Runs queries beside their SQL and compares rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
            return "-"
        if isinstance(x, bool):
            return str(x)
        if hasattr(x, "timestamp"):
            return str(pd.Timestamp(x))
        try:
            return f"{float(x):.6f}" if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    columns = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


def check(spark, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
