"""Compares the rows of a registered query with those of its SQL over one data folder."""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd

ROOT = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def connection():
    import duckdb

    con = duckdb.connect()
    for path in Path(ROOT).iterdir():
        where = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW \"{path.name.split('.')[0]}\" AS SELECT * FROM read_parquet('{where}')")
    return con


def _plain(v):  # noqa: ANN001, ANN202
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float) or type(v).__name__ in ("Decimal", "float32"):
        # whole numbers come as floats where a column holds nulls
        return str(int(v)) if v == int(v) else str(round(float(v), 6))
    return str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    """The frame's rows, columns by name, in one order."""
    return sorted(repr([_plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def agree(query, sql: str, spark, con) -> None:  # noqa: ANN001
    mine, theirs = query(spark, ROOT).toPandas(), con.execute(sql).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
