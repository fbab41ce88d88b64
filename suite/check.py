"""Compare registered queries with their SQL: ``python -m suite.check SF_DIR [NAME ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from suite import queries as _  # noqa: F401
from suite.registry import QUERIES, SQL


def _plain(value: object) -> object:
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf: str, name: str) -> str:
    """Empty when equal, else what differs."""
    result = QUERIES[name](spark, sf)
    columns, got = _rows(result.columns, [tuple(r) for r in result.collect()])
    if name not in SQL:
        return "" if got else "no rows"
    cursor = con.execute(SQL[name])
    expected_columns, expected = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if columns != expected_columns:
        return f"columns {columns} / {expected_columns}"
    if got != expected:
        extra, lost = got - expected, expected - got
        sample = [str(next(iter(c)))[:300] if c else "" for c in (extra, lost)]
        return f"rows {got.total()}/{expected.total()} extra {extra.total()} lost {lost.total()}: {sample}"
    return ""


if __name__ == "__main__":
    from threadloom.session import local_session

    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    session, con = local_session(8), connect(sf)
    session.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            outcome = compare(session, con, sf, name) or "ok"
        except Exception as error:  # noqa: BLE001
            outcome = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:24s} {time.time() - start:6.1f}s {outcome}", flush=True)
