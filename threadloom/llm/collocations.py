"""Collocations: word sequences that occur far more often together than their parts do apart.

Counting is by top-order marginalisation. Each word opens one window: the word and those behind it, up to ``WIDEST`` words
of its piece. Where the texts are, the windows of a chunk are summed to each of their prefixes, down to the number of words
per language; a prefix is one row of a chunk however many windows begin with it, and Spark sums those rows by phrase.

Windows are cut short before they are counted, by a rule that loses no count that matters: a phrase that occurs
``min_count`` times holds no pair and no triple of neighbours that occurs less often. Pairs are counted by their 64-bit
hash, then those triples whose pairs are both frequent; a collision can only keep too much. What reaches ``min_count`` is
marked in a bit table of at most ``TABLE_BITS`` bits per order, which is all that the tasks get. A table that fills up cuts
fewer windows and changes no result.

A null or empty text has no words. A null language is ``und``. Repeated rows count as often as they are there; the ids of
documents play no part. Ties in rank go by ``a``, then by the phrase in byte order. Only the language and the text are
read, so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import column, map_batches, record
from threadloom.session import cut_lineage, release

WIDEST = 4
MIN_COUNT = 30
TOP = 2000
COVERED = 80  # per cent of a phrase's occurrences that lie inside one longer candidate
TABLE_BITS = 1 << 27
BLOCK = 1 << 15  # bits in one bitmap of Spark
CHUNK = 400_000  # words that one step in a task holds
SALTS = 16

_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[9] = 32
_MAP[[*b".,;:!?", 10, 11, 12, 13]] = 255  # no byte of a text in UTF-8
_TABLE = _MAP.tobytes()
_BREAK = b"\xff"


class Table:
    """Bits that mark hashes."""

    def __init__(self, blocks: np.ndarray, bits: int) -> None:
        self.blocks, self.bits = blocks, bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.blocks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


class Words:
    """Words of some documents as numbers: 0 ends a piece, another number is the place of the word's first occurrence."""

    def __init__(self) -> None:
        self.words: list[bytes] = [_BREAK]
        self.lists: list[np.ndarray] = []
        self.seen: dict[str, dict[bytes, int]] = {}
        self.spans: list[tuple[str, int]] = []  # language and first place of each document

    def add(self, lang: str, text: bytes) -> None:
        found = text.translate(_TABLE).replace(_BREAK, b" \xff ").split()
        found.append(_BREAK)
        known = self.seen.setdefault(lang, {_BREAK: 0})
        base = len(self.words)
        self.lists.append(np.fromiter(map(known.setdefault, found, range(base, base + len(found))), np.int64, len(found)))
        self.spans.append((lang, base))
        self.words += found

    def ids(self) -> np.ndarray:
        """The numbers in order, with breaks at the end as far as a window reaches."""
        return np.concatenate([*self.lists, np.zeros(WIDEST, np.int64)])

    def languages(self, ids: np.ndarray) -> list[str]:
        names, starts = zip(*self.spans, strict=True)
        return [names[i] for i in (np.searchsorted(np.array(starts), ids, "right") - 1).tolist()]

    def marks(self, tables: list[Table]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each table whether the words from each place on may be frequent, 2 words for the first table, 3 for the next.

        Also the places and hashes of the order after that, where all that is shorter may be frequent.
        """
        ids = self.ids()
        ok = ids != 0
        hashes = np.zeros(len(self.words), np.uint64)
        distinct = np.unique(ids[ok])
        hashes[distinct] = np.fromiter((xxhash.xxh3_64_intdigest(self.words[i]) for i in distinct.tolist()), np.uint64, len(distinct))
        word = hashes[ids]
        tongues = np.array([xxhash.xxh3_64_intdigest(lang.encode()) for lang, _ in self.spans], np.uint64)
        phrase = word.copy()
        phrase[:-WIDEST] += np.repeat(tongues, [len(x) for x in self.lists])
        found = []
        for order in range(2, len(tables) + 3):
            at = np.flatnonzero(ok[:-1] & ok[1:])
            mixed = phrase[at] * np.uint64(0x9E3779B97F4A7C15) + word[at + order - 1]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            phrase[at] = mixed ^ (mixed >> np.uint64(29))
            if order - 2 < len(tables):
                ok = np.zeros(len(ids), bool)
                ok[at[tables[order - 2].holds(phrase[at])]] = True
                found.append(ok)
        return found, at, phrase[at]


def _chunks(batch: pa.RecordBatch) -> Iterator[Words]:
    words = Words()
    for lang, text in zip(column(batch, "lang"), column(batch, "text"), strict=True):
        if text:
            words.add(lang, text)
        if len(words.words) > CHUNK:
            yield words
            words = Words()
    if words.spans:
        yield words


def frequent(docs: DataFrame, min_count: int, tables: list[Table]) -> Table:
    """Table of the next order: hashes that occur ``min_count`` times. Its bits are a power of two, ``TABLE_BITS`` at most."""

    def work(batch: pa.RecordBatch):
        for words in _chunks(batch):
            keys, counts = np.unique(words.marks(tables)[2], return_counts=True)
            yield record(["hash", "n"], [pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))])

    often = map_batches(docs, work, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    often = cut_lineage(often.select("hash"))
    bits = BLOCK
    wanted = min(TABLE_BITS, 16 * often.count())
    while bits < wanted:
        bits *= 2
    at = F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1
    marked = often.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    blocks = np.zeros(bits // 8, np.uint8)
    for row in marked.toLocalIterator():  # bits / BLOCK rows at most
        blocks[(row.block - 1) * BLOCK // 8 : row.block * BLOCK // 8] = np.frombuffer(bytes(row.bitmap), np.uint8)
    release(often)
    return Table(blocks, bits)


def prefixes(docs: DataFrame, tables: list[Table]) -> DataFrame:
    """``lang, phrase, n``: the prefixes of all windows, cut before what the tables of 2 and 3 words do not have, per chunk.

    The row without a phrase counts the words of a language.
    """

    def cut(words: Words) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """For each length the numbers of the words of every distinct prefix, a column each, and how often it is there."""
        ids = words.ids()
        pairs, triples = words.marks(tables)[0]
        start = np.flatnonzero(ids != 0)
        found, counts = np.unique(ids[start], return_counts=True)
        yield [found], counts
        start = start[pairs[start]]
        key = ids[start]
        for k in range(1, WIDEST):
            if k > 1:
                ok = triples[start + k - 2]
                start, key = start[ok], key[ok]
            # Dense after each step, so two of them fit into 64 bits.
            _, first, key, counts = np.unique(
                key * len(words.words) + ids[start + k], return_index=True, return_inverse=True, return_counts=True
            )
            yield [ids[start[first] + j] for j in range(k + 1)], counts

    def work(batch: pa.RecordBatch):
        for words in _chunks(batch):
            for columns, counts in cut(words):
                distinct, places = np.unique(np.concatenate(columns), return_inverse=True)
                named = pa.array([words.words[i] for i in distinct.tolist()], pa.binary()).cast(pa.string())
                taken = [named.take(pa.array(part)) for part in np.split(places.ravel(), len(columns))]
                phrase = pc.binary_join_element_wise(*taken, " ") if len(taken) > 1 else taken[0]
                langs = pa.array(words.languages(columns[0]), pa.string())
                yield record(["lang", "phrase", "n"], [langs, phrase, pa.array(counts.astype(np.int64))])
                if len(columns) == 1:
                    total: dict[str, int] = {}
                    for lang, n in zip(langs.to_pylist(), counts.tolist(), strict=True):
                        total[lang] = total.get(lang, 0) + n
                    nothing = pa.nulls(len(total), pa.string())
                    yield record(["lang", "phrase", "n"], [pa.array(list(total), pa.string()), nothing, pa.array(list(total.values()), pa.int64())])

    return map_batches(docs, work, "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Written table ``lang, words, f``: every phrase of up to ``WIDEST`` words that occurs ``min_count`` times.

    The row of a language itself, with no words, holds its number of words whatever that is.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    tables: list[Table] = []
    for _ in range(2, WIDEST):
        tables.append(frequent(rows, min_count, tables))
    summed = prefixes(rows, tables).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    kept = summed.where(F.col("phrase").isNull() | (F.col("f") >= min_count))
    words = F.coalesce(F.split("phrase", " "), F.array().cast("array<string>"))
    return cut_lineage(kept.select("lang", words.alias("words"), "f"))


def _exact(c: Column, digits: int) -> Column:
    return c.cast(f"decimal({digits},0)")


def score_cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of each candidate at its weakest cut.

    Products take up to 28 digits, so decimals hold them.
    """
    cuts = candidates.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "size", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    known = counts.select("lang", "phrase", "f")
    both = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = both.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = both.withColumns({"_up": _exact(F.col("a"), 20) * F.lit(2_000_000), "_down": _exact(F.col("l"), 20) + _exact(F.col("r"), 20)})
    best = F.min(F.struct(F.expr("_up div _down").alias("score"), "k", "l", "r")).alias("best")
    return scored.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def covered_by(candidates: DataFrame) -> DataFrame:
    """``lang, phrase, longest``: the largest count of a longer candidate that holds the phrase."""
    spots = [(n, s) for n in range(2, WIDEST) for s in range(1, WIDEST - n + 2)]
    parts = F.array(*[F.when(F.col("size") >= s + n - 1, F.array_join(F.slice("words", s, n), " ")) for n, s in spots])
    inner = candidates.where("size > 2").select("lang", "a", F.col("phrase").alias("longer"), F.explode(F.array_distinct(parts)).alias("phrase"))
    inner = inner.where(F.col("phrase").isNotNull() & (F.col("phrase") != F.col("longer")))
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int | None = TOP, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of 2 to ``WIDEST`` words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts at its weakest cut, ``n`` the words of the language. The best of
    a language are picked in groups by hash first, so that no task sorts all its candidates; without ``top`` the
    candidates come unranked.
    """
    written = phrase_counts(docs, min_count, lang_col, text_col)
    counts = written.where(F.size("words") > 0).select("lang", "words", F.array_join("words", " ").alias("phrase"), "f")
    candidates = counts.where(F.size("words") > 1).withColumnRenamed("f", "a").withColumn("size", F.size("words"))
    covered = (100 * _exact(F.col("longest"), 20) >= COVERED * _exact(F.col("a"), 20)) & F.col("longest").isNotNull()
    kept = score_cuts(candidates, counts).join(covered_by(candidates), ["lang", "phrase"], "left").where(~covered)
    n = written.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    if top is None:
        return kept.join(n, "lang").select("lang", F.lit(None).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = Window.partitionBy("lang", F.pmod(F.crc32(F.col("phrase").cast("binary")), F.lit(SALTS))).orderBy(*order)
    kept = kept.withColumn("place", F.row_number().over(groups)).where(F.col("place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
