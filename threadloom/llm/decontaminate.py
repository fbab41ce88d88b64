"""Benchmark decontamination over a positional inverted index.

The index holds ``(key, pos, term)`` postings of the corpus. Every window of the test items is looked up by
intersecting the posting lists of its terms after subtracting each term's offset, the rarest two lists first, so that
the long lists are only asked about the few places that are left. ``slop`` turns phrases into proximity matches.

Of the corpus, only postings that can be in a match are stored: words that share a hash bucket with a test term, and,
for exact phrases, in a run of at least as many such words as the shortest window has. The buckets are a bit table of
fixed size, whatever the size of the test set; a full table lets everything pass and changes no result.

Nulls, empty texts and texts without words have no postings, no hits and still a row. Repeated rows are one document
each with equal results. An item without words has no window. Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import column, keyed, map_batches, record, runs
from threadloom.session import cut_lineage

BUCKETS = 1 << 20
WINDOW = 10

_WORD = np.full(256, 32, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)
_TABLE = _WORD.tobytes()


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and everything beyond ASCII."""
    return text.translate(_TABLE).split() if text else []


def item_windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``item, terms``: every window of ``width`` words of each item; a shorter item is one window."""

    def work(batch: pa.RecordBatch):
        ids, out = [], []
        for item, text in zip(column(batch, "id"), column(batch, "text"), strict=True):
            found = words(text)
            for start in range(max(1, len(found) - width + 1) if found else 0):
                ids.append(item)
                out.append(found[start : start + width])
        yield record(["item", "terms"], [pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.binary()))])

    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, work, "item long, terms array<binary>")


def build_index(docs: DataFrame, terms: DataFrame, shortest: int) -> DataFrame:
    """Written index ``id, key, pos, term``; a row without a term per document, with its number of words as ``pos``.

    ``docs`` are ``id, key, text``. At most ``BUCKETS`` numbers of the test terms come to the driver.
    """
    buckets = terms.select((F.crc32("term") % BUCKETS).alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)
    table = np.zeros(BUCKETS, bool)
    table[buckets] = True
    packed = np.packbits(table)

    def work(batch: pa.RecordBatch):
        known = np.unpackbits(packed).view(bool)
        ids, keys, places, found_terms = [], [], [], []
        for doc, key, text in zip(*(column(batch, c) for c in ("id", "key", "text")), strict=True):
            found = words(text)
            n = len(found)
            ids.append(doc)
            keys.append(key)
            places.append(n)
            found_terms.append(None)
            if n < shortest:
                continue
            hit = known[np.fromiter(map(crc32, found), np.int64, n) % BUCKETS]
            for start, end in zip(*(x.tolist() for x in runs(hit)), strict=True):
                if end - start >= shortest:
                    ids.extend([doc] * (end - start))
                    keys.extend([key] * (end - start))
                    places.extend(range(start, end))
                    found_terms.extend(found[start:end])
        yield record(
            ["id", "key", "pos", "term"],
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(found_terms, pa.binary())],
        )

    return cut_lineage(map_batches(docs, work, "id long, key long, pos long, term binary"))


def find_windows(postings: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """``window, key, start, length`` where the terms of a window follow each other in a document.

    ``postings`` are ``key, pos, term``; ``windows`` are ``window, offset, term, length``. With ``slop``, each other
    term may be up to so many words off the place that the rarest one sets.
    """
    often = postings.groupBy("term").agg(F.count("*").alias("n"))
    by_window = Window.partitionBy("window").orderBy("n", "offset")
    ranked = (
        windows.join(often, "term")
        .withColumn("rank", F.row_number().over(by_window))
        .withColumn("present", F.count("*").over(Window.partitionBy("window")))
        .where(F.col("present") == F.col("length"))
    )
    ranked = cut_lineage(ranked.select("window", "offset", "term", "length", "rank"))
    rarest = ranked.where("rank = 1").join(postings, "term")
    places = rarest.select("window", "key", (F.col("pos") - F.col("offset")).alias("start"), "length").where("start >= 0")

    def meet(at: DataFrame, terms: DataFrame) -> DataFrame:
        """``at`` with each of ``terms`` that stands at its offset."""
        near = F.sequence(F.lit(-slop), F.lit(slop)) if slop else F.array(F.lit(0))
        due = at.join(terms.select("window", "offset", "term"), "window")
        due = due.withColumn("pos", F.col("start") + F.col("offset"))
        if slop:
            due = due.withColumn("pos", F.explode(F.transform(near, lambda d: F.col("pos") + d)))
        return due.join(postings, ["key", "pos", "term"])

    second = meet(places.where("length > 1"), ranked.where("rank = 2")).select(*places.columns)
    left = places.where("length = 1").union(second)
    rest = meet(left, ranked).groupBy("window", "key", "start", "length").agg(F.countDistinct("offset").alias("n"))
    return rest.where(F.col("n") == F.col("length")).drop("n")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    width: int = WINDOW,
    slop: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: ``id, key, n_words, n_hit, items``.

    ``n_hit`` counts the words inside a match, ``items`` are the ids of the items with a match, sorted as strings.
    """
    cut = cut_lineage(item_windows(items, width, item_id, item_text))
    named = cut_lineage(
        cut.select("terms").distinct().select(F.monotonically_increasing_id().alias("window"), "terms")
    )
    windows = named.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    shortest = named.agg(F.min(F.size("terms"))).first()[0] or 1
    index = build_index(keyed(docs, id_col, text_col), windows.select("term").distinct(), 1 if slop else shortest)
    postings = index.where("term is not null").select("key", "pos", "term")
    found = cut_lineage(find_windows(postings, windows, slop))
    hits = (
        found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"))
        .distinct()
        .groupBy("key")
        .agg(F.count("*").alias("n_hit"))
    )
    of_item = cut.join(named, "terms").select("window", "item").where("item is not null").distinct()
    matched = found.select("key", "window").distinct().join(of_item, "window").select("key", F.col("item").cast("string")).distinct()
    listed = matched.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    per_doc = index.where("term is null").select("id", "key", F.col("pos").alias("n_words"))
    return (
        per_doc.join(hits, "key", "left")
        .join(listed, "key", "left")
        .select(
            "id",
            "key",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
