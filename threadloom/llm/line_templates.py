"""Line dedup by a log-template tree, with DataFrame functions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where tokens with a digit
count as a variable. In a leaf, a token stays part of the template where at least ``min_docs`` different documents have
it at that place; everything else is a variable field. A template that keeps at least ``MIN_FIXED`` words and at least
``CONSTANT`` of a line's words, its tokens without a digit, and that occurs in ``min_docs`` different documents recurs, and its lines are dropped but for the first one, that of
the smallest id and then the smallest line number.

Documents of equal text count as one here, since whole copies are another operator's matter. Lines of fewer than
``MIN_TOKENS`` tokens, blank ones included, are never dropped: they carry too little to be told apart.

Leaves that fewer documents reach cannot hold a recurring template and are left at the first, pre-aggregated count, so
the counting by place works on few lines. No group is gathered: all steps are pre-aggregated counts and equi-joins whose
large partitions Spark may split.

Null texts stay null and empty ones empty. Repeated rows are copies of one document. Columns beside id and text are kept
as they are. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

DEPTH = 3
MIN_DOCS = 10
MIN_TOKENS = 5
MIN_FIXED = 3  # words that a template has at least
CONSTANT = 0.7  # share of a line's words, fields with digits aside, that its template has
VARIABLE = "<*>"


def tokens(line: Column) -> Column:
    """Tokens between spaces, the ones with a digit as a variable."""
    return F.split(F.regexp_replace(line, r"[^ ]*\d[^ ]*", VARIABLE), " ")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, line``: the line numbers to drop of each document, keyed by ``document_key``."""
    raw = F.split("raw", " ")
    head = F.transform(F.slice(raw, 1, DEPTH), lambda t: F.regexp_replace(t, r"\S*\d\S*", VARIABLE))
    lines = (
        docs.select(
            document_key(id_col, text_col).alias("key"),
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("content"),
            F.posexplode(F.split(text_col, "\n")).alias("line", "raw"),
        )
        .where(F.size(raw) >= MIN_TOKENS)
        .select("*", F.xxhash64(F.size(raw), head).alias("leaf"))
    )
    reached = lines.select("leaf", "content").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    busy = lines.join(reached.select("leaf"), "leaf", "left_semi").withColumn("t", tokens(F.col("raw"))).drop("raw")
    busy = cut_lineage(busy.distinct())
    placed = busy.select("leaf", "content", "key", "line", F.posexplode("t").alias("place", "token"))
    often = (
        placed.select("leaf", "place", "token", "content")
        .distinct()
        .groupBy("leaf", "place", "token")
        .agg(F.count("*").alias("n"))
        .where((F.col("n") >= min_docs) & (F.col("token") != VARIABLE))
        .select("leaf", "place", "token")
    )
    fixed = (
        placed.join(often, ["leaf", "place", "token"])
        .groupBy("leaf", "key", "line")
        .agg(F.count("*").alias("n_fixed"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("fields"))
    )
    words = F.filter("t", lambda t: t != VARIABLE)
    shaped = (
        busy.select("leaf", "key", "line", "id", "content", F.size("t").alias("n"), F.size(words).alias("n_words"))
        .join(fixed, ["leaf", "key", "line"])
        .where((F.col("n_fixed") >= MIN_FIXED) & (F.col("n_fixed") >= CONSTANT * F.col("n_words")))
        .select("key", "line", "id", "content", F.xxhash64("leaf", "n", "fields").alias("template"))
    )
    shaped = cut_lineage(shaped)
    wide = shaped.select("template", "content").distinct().groupBy("template").agg(F.count("*").alias("n"))
    first = shaped.groupBy("template").agg(F.min(F.struct("id", "key", "line")).alias("first"))
    kept = wide.where(F.col("n") >= min_docs).join(first, "template").select("template", "first")
    return (
        shaped.join(kept, "template")
        .where(F.struct("id", "key", "line") != F.col("first"))
        .select("key", "line")
        .distinct()
    )


def document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines of recurring templates; ``_n_lines`` and ``_n_dropped`` are appended."""
    drop = recurring_lines(docs, min_docs, id_col, text_col)
    by_doc = drop.groupBy("key").agg(F.collect_set("line").alias("_lines")).withColumnRenamed("key", "_key")
    rows = docs.withColumn("_key", document_key(id_col, text_col)).join(by_doc, "_key", "left")
    parts = F.split(text_col, "\n")
    left = F.filter(F.transform(parts, lambda s, i: F.when(~F.array_contains("_lines", i), s)), lambda s: s.isNotNull())
    return rows.select(
        *[F.when(F.col("_lines").isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull() | (F.col(text_col) == ""), 0).otherwise(F.size(parts)).cast("long").alias("_n_lines"),
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("_n_dropped"),
    )
