"""Compares a frame with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

from loomwright.session import TABLES


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            c.execute(f"create view {name} as select * from read_parquet('{path / '*' if path.is_dir() else path}')")
    return c


def plain(x):
    """Values that compare across engines: floats to 9 digits, no NaN."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


def same(df: DataFrame, sql: str, folder: str) -> None:
    names = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    found = connection(folder).sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({sql}) q").fetchall()
    want = Counter(tuple(plain(v) for v in r) for r in found)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
