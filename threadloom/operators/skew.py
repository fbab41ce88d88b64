"""Equi-join that spreads hot keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

ROWS_PER_BUCKET = 1_000_000


@dataclass(frozen=True)
class Dealt:
    """Build side of a join; ``hot`` lists the keys whose rows are dealt over buckets, if any."""

    rows: DataFrame
    hot: DataFrame | None
    keys: list[str]


def deal(build: DataFrame, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> Dealt:
    """Deal the rows of every key with more than ``rows_per_bucket`` rows over several buckets.

    The keys are counted first. At most ``count(build) / rows_per_bucket`` of them are hot, so the table
    of hot keys is tiny; when there is none the join stays an ordinary one.
    """
    hot = cut_lineage(
        build.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > rows_per_bucket)
        .select(*keys, F.ceil(F.col("_n") / rows_per_bucket).cast("int").alias("_buckets"))
    )
    if hot.isEmpty():
        return Dealt(build, None, keys)
    bucket = F.pmod(F.xxhash64(*build.columns), F.col("_buckets").cast("bigint")).cast("int")
    rows = (
        build.join(hot, keys, "left")
        .withColumn("_bucket", F.coalesce(bucket, F.lit(0)))
        .drop("_buckets")
    )
    return Dealt(rows, hot, keys)


def spread(probe: DataFrame, dealt: Dealt) -> DataFrame:
    """Inner join of ``probe`` with a dealt side; every pair meets exactly once.

    Neither side is broadcast: narrow tables read back from files take many times their files' size in memory, and a
    broadcast that was planned by the files would bring all of that into the driver.
    """
    rows = dealt.rows.hint("merge")
    if dealt.hot is None:
        return probe.join(rows, dealt.keys)
    repeated = (
        probe.join(dealt.hot, dealt.keys, "left")
        .withColumn(
            "_bucket",
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_buckets"), F.lit(1)) - 1)),
        )
        .drop("_buckets")
    )
    return repeated.join(rows, [*dealt.keys, "_bucket"]).drop("_bucket")


def spread_join(
    probe: DataFrame, build: DataFrame, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Inner equi-join where a hot key of ``build`` is split over many tasks."""
    return spread(probe, deal(build, keys, rows_per_bucket))
