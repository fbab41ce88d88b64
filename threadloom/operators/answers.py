"""Reuse of earlier answers: nearest cached query, file-hash validity, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.vectors import nearest

THRESHOLD = 0.92
HIT_RAW_TOKENS, HIT_OPTIMIZED_TOKENS, HIT_SAVINGS = 1000, 0, 100.0


def hashes_valid(cached: Column, current: Column) -> Column:
    """Every cached (path, hash) is present and equal now; an empty map is always valid."""
    return F.forall(
        F.map_entries(cached),
        lambda e: F.coalesce(F.try_element_at(current, e["key"]) == e["value"], F.lit(False)),
    )


def request_file_hashes(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Current hashes of the open files of each request; unknown files are left out."""
    opened = requests.select(
        "request_id", F.explode(F.array_distinct("open_files")).alias("file_path")
    )
    found = (
        opened.join(files.select("file_path", "sha256"), "file_path")
        .groupBy("request_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("file_path", "sha256"))).alias("file_hashes"))
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return (
        requests.select("request_id")
        .join(found, "request_id", "left")
        .withColumn("file_hashes", F.coalesce("file_hashes", none))
    )


def nearest_cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Most similar cached query of each request, the earliest on ties: (request_id, seq, score)."""
    queries = requests.where(F.size("embedding") > 0).select(
        F.col("request_id").alias("query_id"), F.col("embedding").alias("probe")
    )
    stored = cache.select(F.col("seq").alias("id"), F.col("embedding").alias("vector"))
    return (
        nearest(queries, stored, 1)
        .where(F.col("score") > -1.0)
        .select(F.col("query_id").alias("request_id"), F.col("id").alias("seq"), "score")
    )


def answer_lookup(requests: DataFrame, cache: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Cached answer per request, or a miss: (request_id, hit, seq, score, response).

    ``requests(request_id, embedding, file_hashes)`` carry the hashes of now. Only the best match
    counts: when it is stale the request misses, even if the second best would do.
    """
    best = nearest_cached(requests, cache).where(F.col("score") >= threshold)
    entries = cache.select("seq", "response", F.col("file_hashes").alias("cached_hashes"))
    matched = (
        best.join(entries, "seq")
        .join(requests.select("request_id", "file_hashes"), "request_id")
        .where(hashes_valid(F.col("cached_hashes"), F.col("file_hashes")))
        .select("request_id", "seq", "score", "response")
    )
    return (
        requests.select("request_id")
        .join(matched, "request_id", "left")
        .select("request_id", F.col("seq").isNotNull().alias("hit"), "seq", "score", "response")
    )


def append_answers(cache: DataFrame, new: DataFrame, last_seq: int) -> DataFrame:
    """Cache with new rows behind the old ones, numbered on from ``last_seq`` in request order.

    Rows without an embedding are not stored. The numbers grow but may have gaps, as only their order
    matters; so no single task has to count all rows.
    """
    fresh = (
        new.where(F.size("embedding") > 0)
        .repartitionByRange("request_id")
        .sortWithinPartitions("request_id")
        .withColumn("seq", F.monotonically_increasing_id() + F.lit(last_seq + 1))
        .select(*cache.columns)
    )
    return cache.unionByName(fresh)


def audit_rows(requests: DataFrame, lookup: DataFrame, tokens: DataFrame) -> DataFrame:
    """One audit row per request: fixed figures for a hit, measured ones for a miss.

    ``requests`` carry provider, model, user_id, duration_ms and ts.
    """
    hit = F.col("hit")
    return (
        requests.join(lookup.select("request_id", "hit"), "request_id")
        .join(tokens, "request_id", "left")
        .select(
            "user_id",
            "provider",
            "model",
            F.when(hit, F.lit(HIT_RAW_TOKENS)).otherwise(F.coalesce("raw_tokens", F.lit(0))).alias("raw_tokens"),
            F.when(hit, F.lit(HIT_OPTIMIZED_TOKENS))
            .otherwise(F.coalesce("optimized_tokens", F.lit(0)))
            .alias("optimized_tokens"),
            F.when(hit, F.lit(HIT_SAVINGS))
            .otherwise(F.coalesce("token_savings", F.lit(0.0)))
            .alias("savings_percent"),
            "duration_ms",
            "ts",
        )
    )
