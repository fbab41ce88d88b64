"""Substring dedup of word windows by recompression.

The words of a text are recompressed in rounds: runs of one word become one symbol, then pairs of a left symbol and a
right symbol become one, where the symbol's own digest says which it is. Names are digests of what they stand for and so
are global without an exchange; equal word strings get equal symbols but near their ends. Each symbol knows which words
decided it. A window takes as its anchor a symbol of the highest round whose deciding words all lie in the window, of
several the one with the least digest, so equal windows have equal anchors and neighbouring windows mostly share theirs.
Spark brings the anchors together by the words that decided them; those shared between documents reveal repeats, which
are verified on whole windows. See ``repeats``.

A window in which no symbol is decided, as inside a long run, is its own anchor. Windows are judged on the input.
Null and empty texts have no words; texts shorter than a window lose nothing. Rows of one id never take words from each
other, and a null id neither gives nor takes. Texts are taken some at a time, a long one alone. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from threadloom.llm.common import column, keyed, map_batches, record, word_digests
from threadloom.llm.repeats import Digests, covered, marks, scramble, with_marks

WIDTH = 13
ROUNDS = 2
PORTION = 4 << 20  # bytes of text whose words are recompressed at once

_RIGHT = np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64(0xFFFFFFFF)


def join_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after joining runs, and the first and last word that decide each: the run and one word on either side."""
    n = len(symbols)
    starts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    ends = np.concatenate((starts[1:], [n]))
    length = (ends - starts).astype(np.uint64)
    return scramble(symbols[starts] + length * _RIGHT), starts - 1, ends + 1


def join_pairs(symbols: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after joining each left one with a right one behind it; a single one is decided by its neighbour too."""
    right = (symbols & np.uint64(1)).astype(bool)
    pair = np.flatnonzero(~right[:-1] & right[1:])
    named, first, last = symbols.copy(), low.copy(), high.copy()
    lonely_left, lonely_right = ~right, right.copy()
    lonely_left[pair] = False
    lonely_right[pair + 1] = False
    last = np.where(lonely_left, np.append(high[1:], n + 1), last)
    first = np.where(lonely_right, np.concatenate(([-1], low[:-1])), first)
    named[pair] = scramble(symbols[pair] + symbols[pair + 1] * _RIGHT)
    last[pair] = high[pair + 1]
    keep = np.ones(len(symbols), bool)
    keep[pair + 1] = False
    return scramble(named[keep]), first[keep], last[keep]


def _least(keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least key of each range; no range is empty or has more than ``WIDTH`` keys."""
    least = np.zeros(len(start), np.uint64)
    size = end - start
    reach, of_reach = 1, keys
    while reach <= WIDTH:
        now = (size >= reach) & (size < 2 * reach)
        least[now] = np.minimum(of_reach[start[now]], of_reach[end[now] - reach])
        of_reach = np.minimum(of_reach[:-reach], of_reach[reach:])
        reach *= 2
    return least


def anchors(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of several texts, whose words stand one after the other from ``starts`` on, with the end.

    The number of the text, the digests of the deciding words and of the whole stretch, and the range of starts in the text.
    A symbol that two texts decide lies in no window, as windows lie within one.
    """
    windows = np.maximum(np.diff(starts) - (WIDTH - 1), 0)
    total = int(windows.sum())
    if not total:
        return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 2)
    doc = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(total) + (starts[:-1] - (np.cumsum(windows) - windows))[doc]
    low, high = at.copy(), at + WIDTH
    free = np.ones(total, bool)
    layers = [join_runs(symbols)]
    for _ in range(ROUNDS):
        layers.append(join_pairs(*layers[-1], len(symbols)))
    for names, first, last in reversed(layers):
        begin, end = np.searchsorted(first, at), np.searchsorted(last, at + WIDTH, "right")
        good = np.flatnonzero(free & (begin < end))
        keys = (names & ~_PLACE) | np.arange(len(names), dtype=np.uint64)
        chosen = (_least(keys, begin[good], end[good]) & _PLACE).astype(np.int64)
        low[good], high[good] = first[chosen], last[chosen]
        free[good] = False
    changed = (doc[1:] != doc[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | free[1:] | free[:-1]
    lo = np.flatnonzero(np.concatenate(([True], changed)))
    hi = np.concatenate((lo[1:], [total])) - 1
    digests = Digests(scramble(symbols))
    core = digests.of(low[lo], high[lo])
    whole = digests.of(at[lo], at[hi] + WIDTH) ^ scramble((low[lo] - at[lo]).astype(np.uint64))
    begin = starts[doc[lo]]
    return doc[lo], core, whole, at[lo] - begin, at[hi] - begin


def portions(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, as many at a time as have about ``size`` bytes of text, one at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    portion = (np.cumsum(lengths) - lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """``id, key, rank, whole, lo, hi``: the anchors of all texts; ``rank`` is the digest of the deciding words."""

    def work(batch: pa.RecordBatch):
        for part in portions(batch, PORTION):
            doc, core, whole, lo, hi = anchors(*word_digests(part.column("text")))
            ids, keys = (part.column(c).take(pa.array(doc)) for c in ("id", "key"))
            yield record(["id", "key", "rank", "whole", "lo", "hi"], [ids, keys, core.view(np.int64), whole.view(np.int64), lo, hi])

    return map_batches(docs.withColumn("id", docs["id"].cast("long")), work, "id long, key long, rank long, whole long, lo long, hi long")


def _windows(text: bytes, starts: np.ndarray) -> np.ndarray:
    symbols, _ = word_digests(pa.array([text], pa.binary()))
    return Digests(scramble(symbols)).of(starts, starts + WIDTH)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_removed, kept, kept_sha256``: the words left, joined by one space, and what went."""
    rows = keyed(docs, id_col, text_col)
    found = marks(rows, anchor_rows(rows), 1, _windows, earlier=True)

    def work(batch: pa.RecordBatch):
        out = [[] for _ in range(4)]
        for text, lo, hi in zip(*(column(batch, c) for c in ("text", "lo", "hi")), strict=True):
            words = (text or b"").split()
            gone = covered(len(words), lo, hi, WIDTH)
            kept = b" ".join(compress(words, (~gone).tolist()) if lo else words)
            for values, value in zip(out, (len(words), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()), strict=True):
                values.append(value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield record(
            ["id", "n_words", "n_removed", "kept", "kept_sha256"],
            [batch.column(0), *(pa.array(v, t) for v, t in zip(out, types, strict=True))],
        )

    return map_batches(with_marks(rows, found), work, "id long, n_words long, n_removed long, kept string, kept_sha256 string")
