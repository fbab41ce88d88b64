"""File and symbol snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``; aggregated before the shuffle, so hot keys are fine."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
        .select(*keys, *[f"row.{c}" for c in rest])
        .select(*df.columns)
    )


def changed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files that are new or whose content changed."""
    return current.join(previous.select("file_path", "sha256"), ["file_path", "sha256"], "left_anti")


def unchanged_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files whose earlier extraction can be kept."""
    return current.join(previous.select("file_path", "sha256"), ["file_path", "sha256"], "left_semi")


def index_summary(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Number of files and symbols, one row."""
    counts = files.select(F.lit(1).alias("f"), F.lit(0).alias("s")).unionAll(
        symbols.select(F.lit(0).alias("f"), F.lit(1).alias("s"))
    )
    return counts.agg(
        F.coalesce(F.sum("f"), F.lit(0)).alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("symbols")
    )
