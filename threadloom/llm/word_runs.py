"""Runs: stretches of words that repeat with a period, as often as twice or more, and cannot be extended.

Found by enumerating maximal pairs. Two occurrences of the same words, ``p`` words apart, that differ in the word before and
in the word after, form a maximal pair; if their length ``n`` is at least ``p``, both together are a stretch of ``n + p``
words with period ``p`` that no neighbouring word extends. So the maximal pairs whose distance fits their length are the
runs, and nothing is extended afterwards. A run of period ``q`` comes up again at the multiples of ``q``, with the same ends:
the smallest distance of equal ends counts.

Occurrences come from a suffix array by prefix doubling, whose groups are refined only as long as two suffixes of a document
still agree. The LCP-interval tree over it is walked bottom-up with a stack. Every interval holds its places in order, split
into classes by the word to their left; where two intervals meet, each place of the smaller one is asked only for places of
another class within reach, the length of the interval. Intervals shorter than half the least length of a run cannot hold
one and are left out.

Documents are independent, so the work is a map over batches; several documents share one suffix array, with words numbered
apart. A null or empty text has no words and no run, and still a row; a null id is one more id. Repeated rows are one row
each with equal results. Only the id and text columns are read, so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import column, map_batches, record

LEAST = 12  # words in a run
CHUNK = 200_000  # words that share a suffix array

Run = tuple[int, int, int]


def number_words(documents: Iterable[list[bytes]]) -> np.ndarray:
    """All words as numbers that differ between documents, with a number of its own after each document."""
    parts, base = [], 0
    for words in documents:
        known: dict[bytes, int] = {}
        n = len(words)
        parts.append(np.fromiter(map(known.setdefault, words, range(base, base + n)), np.int64, n))
        parts.append(np.array([base + n], np.int64))
        base += n + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def suffixes(text: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose first ``shortest`` words occur again, in the order of their suffixes, and the LCP of each with the next.

    Ranks by the first 1, 2, 4 .. words refine each other; a place drops out once its rank is its own. All of these ranks
    are kept, and comparing them from the longest down gives the LCPs.
    """
    n = len(text)
    counted = np.bincount(text, minlength=n)
    rank = (np.cumsum(counted) - counted)[text].astype(np.int32)  # the group's first place in the order of suffixes
    places, kept = np.flatnonzero(counted[text] > 1), None
    levels, width = [], 1
    while len(places):
        if kept is None and 2 * width > shortest:
            kept = places
        levels.append((width, rank))
        key = rank[places].astype(np.int64) * n + rank[places + width]  # a place that occurs again does not reach the last number
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        old, index = rank[places], np.arange(len(places))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.concatenate(([True], old[1:] != old[:-1]))
        within = np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        rank = rank.copy()
        rank[places] = old + within
        places = places[~(new & np.concatenate((new[1:], [True])))]
        width *= 2
    if kept is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ordered = kept[np.argsort(rank[kept], kind="stable")]
    x, y = ordered[:-1], ordered[1:]
    common = np.zeros(len(x), np.int64)
    for width, ranks in reversed(levels):
        common[ranks[x + common] == ranks[y + common]] += width
    return ordered, np.append(common, 0)


class _Places:
    """Places below one interval: all in order, and by the word to their left."""

    __slots__ = ("all", "classes")

    def __init__(self, place: int, left: int) -> None:
        self.all = [place]
        self.classes = {left: [place]}


def _meet(one: _Places, other: _Places, length: int, least: int, left: list[int], found: dict[tuple[int, int], int]) -> _Places:
    """Report the maximal pairs between two parts of an interval, and join the smaller part to the larger."""
    small, large = (one, other) if len(one.all) <= len(other.all) else (other, one)
    both, classes = large.all, large.classes
    for x in small.all:
        own = left[x]
        low, high = bisect_left(both, x - length), bisect_right(both, x + length)
        if low == high:
            continue
        if high - low <= len(classes):
            near = [y for y in both[low:high] if left[y] != own]
        else:
            near = [y for c, ys in classes.items() if c != own for y in ys[bisect_left(ys, x - length) : bisect_right(ys, x + length)]]
        for y in near:
            start, p = (x, y - x) if x < y else (y, x - y)
            if p + length >= least:
                ends = (start, start + p + length)
                if p < found.get(ends, p + 1):
                    found[ends] = p
    for x in small.all:
        insort(both, x)
    for c, xs in small.classes.items():
        if c in classes:
            for x in xs:
                insort(classes[c], x)
        else:
            classes[c] = xs
    return large


def find_runs(text: np.ndarray, least: int = LEAST) -> list[Run]:
    """``start, length, period`` of all runs in a numbered text, by start, then period."""
    shortest = (least + 1) // 2
    ordered, common = suffixes(text, shortest)
    found: dict[tuple[int, int], int] = {}
    left = np.concatenate(([-1], text[:-1])).tolist() if len(ordered) else []
    stack: list[tuple[int, _Places]] = []
    for place, lcp in zip(ordered.tolist(), common.tolist(), strict=True):
        if lcp < shortest and not stack:
            continue
        now = _Places(place, left[place])
        while stack and stack[-1][0] > lcp:
            length, below = stack.pop()
            now = _meet(below, now, length, least, left, found)
        if stack and stack[-1][0] == lcp:
            now = _meet(stack.pop()[1], now, lcp, least, left, found)
        if lcp >= shortest:
            stack.append((lcp, now))
    return sorted((start, end - start, p) for (start, end), p in found.items())


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that lie in a run after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Fixed rule of the contract: one document in ten goes on periodically from some word on."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def periodic_runs(
    docs: DataFrame, least: int = LEAST, planted: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_words, runs, collapsed`` of every document.

    ``runs`` are ``struct<start, length, period>`` by start, then period; words are counted from 0. ``collapsed`` keeps
    one period of every run. With ``planted``, words are first changed by ``plant``.
    """

    def work(batch: pa.RecordBatch):
        ids, texts = column(batch, "id"), column(batch, "text")
        first, held, size = 0, [], 0
        for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
            words = text.split() if text else []
            held.append(plant(words, doc) if planted else words)
            size += len(words)
            if size >= CHUNK or i + 1 == len(ids):
                yield answer(batch.column(0).slice(first, len(held)), held)
                first, held, size = i + 1, [], 0

    def answer(ids: pa.Array, documents: list[list[bytes]]) -> pa.RecordBatch:
        starts = np.cumsum([0] + [len(w) + 1 for w in documents])
        runs: list[list[Run]] = [[] for _ in documents]
        found = find_runs(number_words(documents), least)
        at = (np.searchsorted(starts, [r[0] for r in found], "right") - 1).tolist()
        for i, (start, length, period) in zip(at, found, strict=True):
            runs[i].append((start - int(starts[i]), length, period))
        kept = [collapse(w, r) for w, r in zip(documents, runs, strict=True)]
        named = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return record(
            ["id", "n_words", "runs", "collapsed"],
            [ids, pa.array([len(w) for w in documents], pa.int64()), pa.array(named, pa.list_(kind)), pa.array(kept, pa.binary()).cast(pa.string())],
        )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, work, f"id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
