"""Savings and throughput over the audit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOLLARS_PER_MILLION_TOKENS = 2.50


def savings_columns() -> list[Column]:
    """Aggregates of the report. A request passed when it had raw tokens; only those are summed."""
    passed = F.col("raw_tokens") > 0
    raw = F.coalesce(F.sum(F.when(passed, F.col("raw_tokens"))), F.lit(0))
    optimized = F.coalesce(F.sum(F.when(passed, F.col("optimized_tokens"))), F.lit(0))
    return [
        F.count("*").alias("requests"),
        F.count(F.when(passed, 1)).alias("passed"),
        F.count(F.when(~passed, 1)).alias("failed"),
        raw.alias("raw_tokens"),
        optimized.alias("optimized_tokens"),
        (raw - optimized).alias("saved_tokens"),
        ((raw - optimized) * 100.0 / F.nullif(raw, F.lit(0))).alias("saved_percent"),
        F.avg(F.when(passed, F.col("savings_percent"))).alias("mean_savings_percent"),
        F.avg(F.when(passed, F.col("duration_ms"))).alias("mean_duration_ms"),
        ((raw - optimized) * DOLLARS_PER_MILLION_TOKENS / 1_000_000).alias("dollars_saved"),
    ]


def savings_report(audit: DataFrame, by: list[str] | None = None) -> DataFrame:
    return audit.groupBy(*(by or [])).agg(*savings_columns())


def throughput(audit: DataFrame) -> DataFrame:
    """Requests per second between the first and the last row."""
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return audit.agg(
        F.count("*").alias("requests"),
        (span / 1_000_000).alias("seconds"),
        (F.count("*") / F.nullif(span / 1_000_000, F.lit(0.0))).alias("requests_per_second"),
    )
