"""Hold a query's rows against those of its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


def _rows(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def differences(frame: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Nothing if both have the same columns and rows; otherwise what differs first."""
    ours = _rows(frame.columns, frame.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows; {[x for x in ours if x not in theirs][:2]} / {[x for x in theirs if x not in ours][:2]}"
    wrong = [(x, y) for x, y in zip(ours, theirs, strict=True) if x != y or any(type(a) is not type(b) for a, b in zip(x, y, strict=True))]
    return f"{len(wrong)} rows, first {wrong[0]}" if wrong else ""
