"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a row belongs to the owner of the next point clockwise from the hash of its id.
A shard takes as many rows as its capacity says; rows that find it full go on clockwise to the next point. With the
capacities of an equal split (``slack`` 0) every shard ends up full, so counts differ by one at most; a slack leaves more
rows where the ring alone puts them.

The overflow is settled on counts of rows per arc of the ring, so the driver sees ``shards * points`` numbers whatever the
corpus. Rows find their place by their rank within the arc, which is taken over buckets of the hash.

Null ids and null texts are values like others; a null text has size 1. Equal rows get places of their own; they may swap
them. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import map_batches, record
from threadloom.llm.packing import ranked
from threadloom.session import cut_lineage

POINTS = 64
SPACE = 1 << 32


def ring(shards: int, points: int = POINTS) -> tuple[list[int], list[int]]:
    """Sorted points of the ring and the shard that owns each."""

    def at(shard: int, point: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{shard}/{point}".encode()).digest()[:4], "big")

    all_points = sorted((at(s, p), s) for s in range(shards) for p in range(points))
    return [p for p, _ in all_points], [s for _, s in all_points]


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may take: an equal split, widened by the slack."""
    if slack > 0:
        return [int(np.ceil(rows * (1 + slack) / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def settle(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """``(arc, first rank, shard, number)`` for the rows of every arc.

    All arcs fill their own shard first, in ring order; then what is left of each goes one point further, and so on.
    """
    room = list(room)
    placed = [0] * len(counts)
    out = []
    for away in range(len(counts)):
        for arc, count in enumerate(counts):
            shard = owners[(arc + away) % len(owners)]
            take = min(count - placed[arc], room[shard])
            if take > 0:
                out.append((arc, placed[arc], shard, take))
                placed[arc] += take
                room[shard] -= take
        if placed == counts:
            break
    return out


def assign(
    docs: DataFrame, shards: int, slack: float = 0.0, points: int = POINTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, size, crc, home, shard, slot``: ``home`` is what the ring alone says."""
    places, owners = ring(shards, points)
    place_array = np.array(places)

    def locate(batch: pa.RecordBatch):
        arc = np.searchsorted(place_array, batch.column(3).to_numpy()) % len(places)
        yield record([*batch.schema.names, "arc"], [*batch.columns, pa.array(arc.astype(np.int64))])

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"),
        F.pmod(F.xxhash64(id_col), F.lit(SPACE)).alias("hash"),
    )
    rows = cut_lineage(map_batches(rows, locate, "id long, size long, crc long, hash long, arc long"))
    by_arc = dict(rows.groupBy("arc").count().collect())
    counts = [by_arc.get(a, 0) for a in range(len(places))]
    filled = [0] * shards
    slots = []
    for arc, rank, shard, number in settle(counts, owners, capacities(sum(counts), shards, slack)):
        slots.append((arc << 48 | rank, shard, filled[shard] - rank))
        filled[shard] += number
    slots.sort()
    keys, shard_of, shift = (np.array(x, np.int64) for x in zip(*slots, strict=True)) if slots else (np.zeros(0, np.int64),) * 3
    home = np.array(owners, np.int64)

    def place(batch: pa.RecordBatch):
        arc, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("arc", "rank"))
        at = np.searchsorted(keys, arc << 48 | rank, "right") - 1
        yield record([*batch.schema.names, "home", "shard", "slot"], [*batch.columns, home[arc], shard_of[at], shift[at] + rank])

    names = ["id", "size", "crc", "arc", "rank"]
    in_order = ranked(rows.drop("hash"), "arc", ["id", "crc", "size"])
    return map_batches(in_order.select(*names), place, ", ".join(f"{c} long" for c in [*names, "home", "shard", "slot"])).drop("arc", "rank")


def owner(number: int, places: list[int], owners: list[int]) -> int:
    """Shard that the ring alone gives to a hash."""
    return owners[bisect.bisect_left(places, number) % len(places)]
