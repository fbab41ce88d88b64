"""Packing token sequences by cutting-stock column generation.

Documents are cut at every full sequence; what is left over has any length. The histogram of the piece lengths, in
classes of ``GRAIN`` tokens, is a cutting-stock problem: which combinations of classes (patterns) to fill how many
sequences with. A linear program over the patterns is solved by column generation, where a knapsack dynamic program
finds the pattern of the highest value at the current prices. The solution is rounded down; the few pieces that this
leaves are packed first-fit decreasing into patterns of their own. Ranked pieces of each class then take the slots.

The driver sees the histogram and the patterns only, at most ``capacity / GRAIN`` classes whatever the corpus. Ranks
within a class are dealt over hash buckets, so a length that a third of all documents share is no single task's work.
Token ids stay in the task that makes them.

A null or empty text is one end token. Repeated rows are packed once each; ties are broken by id, start and checksum, and
equal rows may swap places. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm.common import column, map_batches, record
from threadloom.session import cut_lineage

CAPACITY = 2048
GRAIN = 4
END = 1
GAP = 0.0005
RANK_BUCKETS = 128

# Fixed value: what a byte-level tokenizer takes as one word.
_WORDS = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND_LATIN = regex.compile(r"[^\x00-\u024F]")
_loaded: dict[str, Encoder] = {}


class Encoder:
    """Token ids as little-endian bytes.

    A byte-level vocabulary whose ids are the ranks of its merges, and which gives each of its tokens back as that one token, is
    run by ``tiktoken`` on the same ranks: then two neighbours that join into a token are always the pair that its merge names, so
    joining by rank gives the tokenizer's ids. Where the file says otherwise, and for texts with characters beyond Latin, whose
    classes the two libraries might see differently, or with a special token spelt out, the tokenizer itself is asked.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _ranks(path, self.tokenizer)
        self.fast = ranks and tiktoken.Encoding(path, pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.fast or _BEYOND_LATIN.search(text) or any(token in text for token in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def _ranks(path: str, tokenizer: Tokenizer) -> dict[bytes, int] | None:
    """Rank of each token's bytes, None where ranks alone do not tell the ids."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    model, before = parts["model"], parts["pre_tokenizer"] or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or parts["normalizer"] or any(before.get(k) != v for k, v in plain.items()):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    letters = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letters)}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(vocab) != 256 + len(merges) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    if any(len(found := tokenizer.model.tokenize(token)) != 1 or found[0].id != i for token, i in vocab.items()):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items()}


def encoder(path: str) -> Encoder:
    """One encoder a worker, without threads of its own: Spark has as many workers as cores."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start, length, crc, total``: the documents with their end token, cut at every ``capacity`` tokens."""

    def work(batch: pa.RecordBatch):
        encode = encoder(path).encode
        end = np.array([END], "<u4").tobytes()
        ids, starts, lengths, sums, totals = [], [], [], [], []
        for doc, text in zip(column(batch, "id"), column(batch, "text"), strict=True):
            data = encode(text or "") + end
            for at in range(0, len(data), 4 * capacity):
                part = data[at : at + 4 * capacity]
                ids.append(doc)
                starts.append(at // 4)
                lengths.append(len(part) // 4)
                sums.append(crc32(part))
                totals.append(len(data) // 4)
        yield record(
            ["id", "start", "length", "crc", "total"], [pa.array(x, pa.int64()) for x in (ids, starts, lengths, sums, totals)]
        )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return cut_lineage(map_batches(rows, work, "id long, start long, length long, crc long, total long"))


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack: the most valuable multiset of sizes 1, 2, ... (``prices[i]`` for size ``i + 1``) within the capacity."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        k = min(room, len(prices))
        values = prices[:k] + best[room - 1 :: -1][:k]
        at = int(values.argmax())
        if values[at] > best[room - 1] + 1e-12:
            best[room], last[room] = values[at], at + 1
        else:
            best[room] = best[room - 1]
    counts = np.zeros(len(prices), np.int64)
    room = capacity
    while room:
        if last[room]:
            counts[last[room] - 1] += 1
            room -= last[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """One pattern a size, largest first, each filled greedily and used until a size runs out, and their uses."""
    m = len(sizes)
    left = demand.astype(float)
    patterns, used = [], []
    for big in range(m - 1, -1, -1):
        while left[big] > 0:
            counts, room = np.zeros(m, np.int64), capacity
            for j in range(big, -1, -1):
                if left[j] > 0 and sizes[j] <= room:
                    counts[j], room = divmod(room, int(sizes[j]))
                    if room < sizes[0]:
                        break
            inside = counts.nonzero()[0]
            times = (left[inside] / counts[inside]).min()
            left[inside] -= times * counts[inside]
            done = [j for j in inside if left[j] <= 1e-9]
            left[done] = 0
            patterns.append(counts)
            used.append(times)
            for j in done[1:]:
                alone = np.zeros(m, np.int64)
                alone[j] = capacity // sizes[j]
                patterns.append(alone)
                used.append(0.0)
    return patterns, np.array(used)


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns over ``sizes`` and how often each is used, at most ``gap`` above the linear program's optimum.

    Revised simplex with an explicit inverse, ended by Farley's bound. After two pivots a size it ends anyway: every
    basis is a packing, so that costs padding and nothing else.
    """
    patterns, used = first_basis(sizes, demand, capacity)
    inverse = np.linalg.inv(np.array(patterns, float).T)
    bound = sizes @ demand / capacity
    for _ in range(2 * len(sizes)):
        prices = inverse.sum(0)
        by_size = np.zeros(sizes.max())
        by_size[sizes - 1] = np.maximum(prices, 0)
        value, counts = best_pattern(by_size, capacity)
        bound = max(bound, prices @ demand / max(value, 1e-12))
        if used.sum() <= (1 + gap) * bound or value <= 1 + 1e-9:
            break
        entering = counts[sizes - 1]
        change = inverse @ entering
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * change, 0)
        used[out] = step
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        patterns[out] = entering
    return list(zip(patterns, used, strict=True))


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns as ``{size: count}`` with whole numbers of uses that take up exactly the demand."""
    if not len(sizes):
        return []
    out: list[tuple[dict[int, int], int]] = []
    left = dict(zip(sizes.tolist(), demand.tolist(), strict=True))
    for counts, times in column_generation(sizes, demand.astype(float), capacity):
        whole = int(times + 1e-6)
        pattern = {int(s): int(c) for s, c in zip(sizes, counts, strict=True) if c}
        whole = min([whole, *(left[s] // c for s, c in pattern.items())])
        if whole > 0:
            out.append((pattern, whole))
            for s, c in pattern.items():
                left[s] -= c * whole
    bins: list[tuple[int, dict[int, int]]] = []
    for size in sorted((s for s, n in left.items() if n), reverse=True):
        for _ in range(left[size]):
            for i, (room, pattern) in enumerate(bins):
                if room >= size:
                    bins[i] = (room - size, pattern | {size: pattern.get(size, 0) + 1})
                    break
            else:
                bins.append((capacity - size, {size: 1}))
    return out + [(pattern, 1) for _, pattern in bins]


def ranked(rows: DataFrame, group: str, order: list[str], buckets: int = RANK_BUCKETS) -> DataFrame:
    """``rows`` with ``rank`` from 0 within each ``group``, without gathering a group in one task."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy(group, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*order)) - 1
    return rows.withColumn("inside", inside).join(base, [group, "bucket"]).withColumn("rank", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, start, length, crc, total, sequence, offset``: where every piece lies."""
    cut = pieces(docs, path, capacity, id_col, text_col).withColumn("size", F.ceil(F.col("length") / grain))
    histogram = cut.groupBy("size").count().orderBy("size").toPandas()
    sizes, demand = histogram["size"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64)
    taken = dict.fromkeys(sizes.tolist(), 0)
    slots, first = [], 0
    for pattern, times in plan(sizes, demand, capacity // grain):
        slot = 0
        for size, count in sorted(pattern.items(), reverse=True):
            slots.append((size, taken[size], count, first, slot))
            taken[size] += count * times
            slot += count
        first += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]

    def place(batch: pa.RecordBatch):
        size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("size", "rank"))
        at = np.searchsorted(keys, size << 48 | rank, "right") - 1
        _, start, count, sequence, slot = table[at].T
        behind = rank - start
        yield record(
            [*batch.schema.names, "sequence", "slot"], [*batch.columns, sequence + behind // count, slot + behind % count]
        )

    rows = ranked(cut, "size", ["id", "start", "crc", "total"])
    names = ["id", "start", "length", "crc", "total", "size", "rank"]
    placed = map_batches(rows.select(*names), place, ", ".join(f"{c} long" for c in [*names, "sequence", "slot"]))
    before = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return placed.withColumn("offset", offset).drop("size", "rank", "slot")
