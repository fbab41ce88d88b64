"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut_lineage, release


TABLE_BITS = 1 << 24  # 2 MB of marks, 262,144 words


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of a row. Rows equal in id and text share it and get the same result; a null id is one more id."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, text`` with the text as UTF-8 bytes and nothing else, whatever other columns there are."""
    return docs.select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("text")
    )


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def may_have(rows: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """The rows whose 64-bit digest ``col`` may be one of ``keys``, without an exchange of them; others may stay, too.

    The keys mark bits in a table of ``TABLE_BITS`` at most, which is sent to all tasks as words of 64 bits. A full table
    lets everything pass. A null passes nothing.
    """
    bits = 1 << 10
    wanted = min(TABLE_BITS, 8 * keys.count())
    while bits < wanted:
        bits *= 2
    place = F.col(col).bitwiseAND(F.lit(bits - 1))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_word", word).join(F.broadcast(words), "_word")
    return marked.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def record(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names)


def word_digests(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all texts of a batch, one after the other, and where each text's begin, with the end.

    Words are what white space of ASCII leaves. Each different word of the batch is hashed once. A null has no words.
    """
    texts = texts.view(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = lists.flatten()
    real = pc.not_equal(words, "")
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    starts = before[np.concatenate(([0], np.cumsum(counts)))]
    coded = words.filter(real).dictionary_encode()
    kinds = coded.dictionary.view(pa.binary()).to_pylist()
    digests = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))
    return digests[coded.indices.to_numpy()], starts


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges: root is the smallest node reachable.

    Large-star and small-star steps take turns: each node's neighbours are linked to the smallest of them. Every round
    is a pre-aggregated minimum and an equi-join, whose large partitions Spark may split, so a node with very many
    neighbours is no single task's work. Rounds are few, the logarithm of the longest chain; each is written to the
    shared folder and the one before is deleted.
    """
    now = cut_lineage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        after = cut_lineage(after.distinct())
        changed = not (after.count() == now.count() and after.exceptAll(now).isEmpty())
        release(now, large)
        now = after
        if not changed:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
