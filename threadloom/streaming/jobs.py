"""Structured Streaming versions: incremental index, answer lookup, running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.answers import THRESHOLD, answer_lookup, append_answers
from threadloom.operators.catalog import changed_files, last_wins
from threadloom.operators.report import savings_columns
from threadloom.session import cut_lineage, release
from threadloom.sources.keyed import KeyedTable


def _versioned(folder: str, batch: int) -> str:
    return f"{folder}/batch={batch:012d}"


def stream_changed_files(
    versions: DataFrame,
    files: KeyedTable,
    symbols: KeyedTable,
    checkpoint: str,
    parse: Callable[[DataFrame], DataFrame],
    first: int = 1,
) -> StreamingQuery:
    """Keep a table of files and one of what is parsed from them up to date with a stream of file versions.

    ``versions(file_path, sha256, version, ...)`` carry the files as they arrive. A micro-batch keeps the last version per
    path, compares it with the files as they were before the batch, and puts the changed files and their symbols, both by
    path: a file that returns to an earlier content changes back, and one without symbols has none. The puts are numbered
    from ``first``, so a batch that runs again after a failure sees what it saw before and replaces its own puts. No
    streaming state grows with the number of files.
    """

    def merge(batch: DataFrame, number: int) -> None:
        known = files.read(batch.sparkSession, before=first + number)
        newest = last_wins(batch, ["file_path"], ["version", "sha256"])
        changed = cut_lineage(changed_files(newest, known))
        symbols.put(parse(changed), first + number, touched=changed)
        files.put(changed, first + number)
        release(changed)

    return (
        versions.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_answer_lookup(
    requests: DataFrame,
    cache: KeyedTable,
    out: str,
    checkpoint: str,
    threshold: float = THRESHOLD,
    answer: Callable[[DataFrame], DataFrame] | None = None,
    first: int = 1,
) -> StreamingQuery:
    """Look up every arriving request in the answer cache, and keep the answers to those that miss.

    ``answer`` turns the misses of a micro-batch into cache rows without ``seq``; a later batch finds them. A batch sees the
    cache as it was before its own put, numbered from ``first``, so running it again gives the same and adds nothing twice.
    """

    def lookup(batch: DataFrame, number: int) -> None:
        known = cache.read(batch.sparkSession, before=first + number)
        found = cut_lineage(answer_lookup(batch, known, threshold))
        found.write.mode("overwrite").parquet(_versioned(out, number))
        if answer is not None:
            misses = batch.join(found.where(~F.col("hit")), "request_id", "left_semi")
            last = known.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            cache.put(append_answers(known.limit(0), answer(misses), last), first + number)
        release(found)

    return (
        requests.writeStream.foreachBatch(lookup)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def windowed_savings(audit: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Savings report per time window; works on a stream and on a table."""
    return (
        audit.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("span"))
        .agg(*savings_columns())
        .select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "*")
        .drop("span")
    )


def stream_savings(audit: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the windowed report up to date: closed windows are appended to ``out``."""
    return (
        windowed_savings(audit)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
