"""Table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadloom.schemas import AUDIT, CCR, FILES
from threadloom.sources.keyed import KeyedTable


def append_audit(rows: DataFrame, path: str) -> None:
    rows.select(*[f.name for f in AUDIT]).write.mode("append").parquet(path)


def ccr_table(path: str) -> KeyedTable:
    """Bodies by key; a key that is put again stays one row."""
    return KeyedTable(path, ["key"], CCR)


def file_table(path: str) -> KeyedTable:
    """The files of an index by path."""
    return KeyedTable(path, ["file_path"], FILES)
