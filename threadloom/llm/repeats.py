"""Where windows of one length occur again: the part that byte and word repeats share.

Windows are represented by anchors, places inside them that only their own content decides, so that equal windows have
equal anchors. An anchor row has the digest of a core that lies in all its windows, a digest of the whole stretch they
cover, and the range of their starts. Anchors with a core of their own drop out. Where the whole stretch occurs again, all
its windows do, without being listed. Only where stretches of one core differ are windows listed, one stretch of each
kind, and counted on their own. Counts are pre-aggregated and joined back; nothing is gathered but the marks of a document.

Digests have 64 bits and are taken as the windows: among n different stretches that meet in one count, about n * n / 2**65
pairs share a digest by chance, 3 in ten billion stretches and some hundreds in a hundred billion.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import column, map_batches, may_have, record
from threadloom.session import cut_lineage, release

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64; grown on demand, once a worker."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 17), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Digests:
    """Digests of any stretch of a sequence of 64-bit symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(BASE, n), out=self.sums[1:])
        self.down = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return scramble((self.sums[end] - self.sums[start]) * self.down[start] + length * np.uint64(0xD6E8FEB86659FD93))


Anchors = Callable[[bytes], list[np.ndarray]]
ANCHOR_COLUMNS = ["id", "key", "cores", "whole", "lo", "hi"]


def anchor_rows(docs: DataFrame, anchors: Anchors) -> DataFrame:
    """Rows of ``ANCHOR_COLUMNS``: ``anchors`` gives core digests by level, ``whole, lo, hi`` for a text."""

    def work(batch: pa.RecordBatch):
        for doc, key, text in zip(*(column(batch, c) for c in ("id", "key", "text")), strict=True):
            for cores, whole, lo, hi in anchors(text or b""):
                n = len(lo)
                if not n:
                    continue
                levels = cores.shape[1]
                nested = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, n * levels + 1, levels, dtype=np.int32)), pa.array(np.ascontiguousarray(cores).view(np.int64).ravel())
                )
                yield record(
                    ANCHOR_COLUMNS,
                    [pa.array([doc] * n, pa.int64()), pa.array(np.full(n, key)), nested, whole.view(np.int64), lo.astype(np.int64), hi.astype(np.int64)],
                )

    return map_batches(docs, work, "id long, key long, cores array<long>, whole long, lo long, hi long")


def marks(docs: DataFrame, rows: DataFrame, levels: int, listed: Callable[[bytes, np.ndarray], np.ndarray], earlier: bool) -> DataFrame:
    """``key, lo, hi``: ranges of starts of windows that occur elsewhere.

    With ``earlier``, elsewhere is a document of a smaller id; otherwise any other place. ``docs`` are ``id, key, text``,
    ``rows`` their anchors, with a ``rank`` in place of ``cores`` where there is one level; ``listed`` gives the digests of
    the windows at some starts.
    """
    rows = cut_lineage(rows if levels == 1 else rows.withColumn("rank", F.element_at("cores", 1)))
    written = [rows]
    for level in range(1, levels + 1):
        if level > 1:
            rows = rows.withColumn("rank", F.xxhash64("rank", F.element_at("cores", level)))
        counts = rows.groupBy("rank").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.max("id").alias("high"))
        again = counts.where("low < high" if earlier else "c > 1").select("rank")
        if level == 1:  # most anchors have a core of their own; a filter spares them the exchange
            again = cut_lineage(again)
            rows = may_have(rows, "rank", again)
            written.append(again)
        after = cut_lineage(rows.join(again, "rank", "left_semi"))
        release(*written)
        rows, written = after, [after]
    shared = rows.drop("cores")
    kinds = shared.groupBy("rank", "whole").agg(
        F.count("*").alias("c"), F.min("id").alias("first"), F.min(F.struct("key", "lo")).alias("one")
    )
    kinds = cut_lineage(kinds)
    if earlier:
        again = shared.join(kinds.select("rank", "whole", "first"), ["rank", "whole"]).where("id > first")
    else:
        again = shared.join(kinds.where("c > 1").select("rank", "whole"), ["rank", "whole"], "left_semi")
    again = again.select("key", "lo", "hi")
    mixed = kinds.groupBy("rank").agg(F.count("*").alias("kinds")).where("kinds > 1").select("rank")
    one = kinds.join(mixed, "rank").select("rank", "whole", F.col("one.key").alias("key"), F.col("one.lo").alias("lo"), "first")
    if earlier:
        some = shared.join(one.select("rank", "whole", "first"), ["rank", "whole"]).where("id = first").select("key", "lo", "hi")
    else:
        some = shared.join(one.select("rank", "whole", "key", "lo"), ["rank", "whole", "key", "lo"]).select("key", "lo", "hi")
    ranges = some.distinct().groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def work(batch: pa.RecordBatch):
        for doc, key, text, found in zip(*(column(batch, c) for c in ("id", "key", "text", "ranges")), strict=True):
            starts = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in found]))
            n = len(starts)
            yield record(
                ["id", "key", "digest", "lo"],
                [pa.array([doc] * n, pa.int64()), pa.array(np.full(n, key)), listed(text or b"", starts).view(np.int64), starts.astype(np.int64)],
            )

    windows = map_batches(docs.join(ranges, "key").select("id", "key", "text", "ranges"), work, "id long, key long, digest long, lo long")
    windows = cut_lineage(windows)
    counts = cut_lineage(windows.groupBy("digest").agg(F.count("*").alias("c"), F.min("id").alias("first")).where("c > 1"))
    hit = may_have(windows, "digest", counts).join(counts, "digest")
    if earlier:
        hit = hit.where("id > first")
    return again.union(hit.select("key", "lo", F.col("lo").alias("hi"))).distinct()


def with_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``id, key, text, lo, hi`` with the ranges of each document as arrays, null where there are none."""
    per_doc = found.groupBy("key").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    return docs.join(per_doc, "key", "left").select("id", "key", "text", "lo", "hi")


def covered(n: int, lo: list | None, hi: list | None, width: int) -> np.ndarray:
    """Which of ``n`` places lie in a window that starts in one of the ranges."""
    edges = np.zeros(n + 1, np.int64)
    if lo:
        np.add.at(edges, np.array(lo), 1)
        np.add.at(edges, np.array(hi) + width, -1)
    return np.cumsum(edges[:n]) > 0
