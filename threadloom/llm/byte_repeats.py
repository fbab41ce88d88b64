"""Suffix-array dedup of byte strings by distributed prefix doubling over sampled suffixes.

Ranking the suffixes at every byte would sort as many rows as the corpus has bytes, several times. A suffix is therefore
kept where its first bytes hash lowest within half a window, which every window has at a place that its own content
decides. Spark ranks the kept suffixes by their first 50 bytes, then by the pair of that rank and the bytes up to 101, then
up to 201; suffixes that are alone at a step go no further. The last doubling, to the whole ``WIDTH``, is done for all
byte positions that are left in question. See ``repeats`` for how stretches that repeat as a whole are settled at once.

All digests are judged on the input. Null and empty texts have nothing to remove. Repeated rows are documents of their
own, so all of a text of at least ``WIDTH`` bytes goes from each. A long text is taken in slabs. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm.common import column, keyed, map_batches, record, runs
from threadloom.llm.repeats import Digests, anchor_rows, covered, marks, scramble, with_marks

WIDTH = 400
SAMPLE = 200
GRAM = 16
STEPS = (0, 50, 101, 201)
SLAB = 1 << 20

_SYMBOLS = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = np.uint64(0xFFFFFFFF)


def _symbols(text: bytes) -> np.ndarray:
    return _SYMBOLS[np.frombuffer(text, np.uint8)]


def suffixes(text: bytes):
    """The sampled suffixes of a text, slab by slab: digests of their steps, of the whole stretch, and the range of starts."""
    for first in range(0, max(len(text) - WIDTH + 1, 0), SLAB):
        part = text[first : first + SLAB + WIDTH - 1]
        n = len(part)
        digests = Digests(_symbols(part))
        at = np.arange(n - GRAM + 1)
        least = (digests.of(at, at + GRAM) & ~_PLACE) | at.astype(np.uint64)
        reach = 1
        while reach * 2 <= SAMPLE:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[: len(least) - (SAMPLE - reach)], least[SAMPLE - reach :])
        places = (least[: n - WIDTH + 1] & _PLACE).astype(np.int64)
        lo = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        hi = np.concatenate((lo[1:], [len(places)])) - 1
        a = places[lo]
        cores = np.stack([digests.of(a + x, a + y) for x, y in zip(STEPS, STEPS[1:], strict=False)], axis=1)
        whole = digests.of(lo, hi + WIDTH) ^ scramble((a - lo).astype(np.uint64))
        yield cores, whole, lo + first, hi + first


def _windows(text: bytes, starts: np.ndarray) -> np.ndarray:
    out = []
    for first in range(0, len(text), SLAB):
        inside = starts[(starts >= first) & (starts < first + SLAB)] - first
        if len(inside):
            digests = Digests(_symbols(text[first : first + SLAB + WIDTH - 1]))
            out.append(digests.of(inside, inside + WIDTH))
    return np.concatenate(out)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept, kept_sha256``: the bytes left, and what went."""
    rows = keyed(docs, id_col, text_col)
    found = marks(rows, anchor_rows(rows, suffixes), len(STEPS) - 1, _windows, earlier=False)

    def work(batch: pa.RecordBatch):
        out = [[] for _ in range(5)]
        for text, lo, hi in zip(*(column(batch, c) for c in ("text", "lo", "hi")), strict=True):
            data = np.frombuffer(text or b"", np.uint8)
            gone = covered(len(data), lo, hi, WIDTH)
            kept = data[~gone].tobytes()
            for values, value in zip(out, (len(data), int(gone.sum()), len(runs(gone)[0]), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                values.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        yield record(
            ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            [batch.column(0), *(pa.array(v, t) for v, t in zip(out, types, strict=True))],
        )

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return map_batches(with_marks(rows, found), work, schema)
