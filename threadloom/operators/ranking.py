"""Relevance of symbols for a batch of requests."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import MIN_TERM_BYTES, fields, query_terms, query_words
from threadloom.operators.linking import Links
from threadloom.operators.substring import substring_matches
from threadloom.operators.traverse import MAX_DEPTH, link_distance
from threadloom.session import cut_lineage

NAME_WEIGHT, SIGNATURE_WEIGHT, BODY_WEIGHT = 5, 3, 1
ACTIVE_BONUS, OPEN_BONUS = 1.5, 0.5
SCORE_DIGITS = 9  # scores closer than this count as equal
CURSOR_BUCKET_LINES = 512
WINDOW_ROWS = 2_000_000  # largest request ranked by one window group
RANK_BLOCK = 1000
TERMS_PER_TASK = 100_000  # most terms that a task holds to search texts for
WORDS_KEPT = 100_000  # words whose terms a batch remembers


def cursor_symbol(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol under the cursor of each request: the tightest span, then the smallest id.

    An interval join, binned by line range so that one big file does not end up in one task.
    """
    spans = symbols.select(
        "file_path",
        "line_start",
        "line_end",
        "id",
        F.explode(
            F.sequence(
                F.floor(F.col("line_start") / CURSOR_BUCKET_LINES),
                F.floor(F.greatest("line_end", "line_start") / CURSOR_BUCKET_LINES),
            )
        ).alias("bin"),
    )
    cursors = requests.where((F.col("cursor_file") != "") & (F.col("cursor_line") > 0)).select(
        "request_id",
        F.col("cursor_file").alias("file_path"),
        "cursor_line",
        F.floor(F.col("cursor_line") / CURSOR_BUCKET_LINES).alias("bin"),
    )
    return (
        cursors.join(spans, ["file_path", "bin"])
        .where(F.col("cursor_line").between(F.col("line_start"), F.col("line_end")))
        .groupBy("request_id")
        .agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "id")).alias("best"))
        .select("request_id", F.col("best.id").alias("id"))
    )


def open_file_symbols(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols standing in an open file of each request."""
    opened = requests.select(
        "request_id", F.explode(F.array_distinct("open_files")).alias("file_path")
    )
    return opened.join(symbols.select("file_path", "id"), "file_path").select("request_id", "id")


def seed_union(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Start set of each request: the symbol under the cursor and those of open files."""
    return cursor_symbol(requests, symbols).unionByName(open_file_symbols(requests, symbols)).distinct()


def request_terms(requests: DataFrame) -> DataFrame:
    """Matched words of each request with how often they occur: (request_id, term, times)."""
    return (
        requests.select("request_id", F.explode(query_terms(F.col("query"))).alias("term"))
        .groupBy("request_id", "term")
        .agg(F.count("*").alias("times"))
    )


def term_weights(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """Best weight of every term inside every symbol that contains it: (term, id, weight).

    Terms hold no white space, so an occurrence lies inside one word. The texts of an id are brought together once and
    searched where they are for all terms, which every task holds; beyond ``TERMS_PER_TASK`` of them symbols meet terms
    through the vocabulary of their words.
    """

    distinct = terms.select("term").distinct()
    few = distinct.limit(TERMS_PER_TASK + 1).collect()
    if len(few) > TERMS_PER_TASK:
        return _weights_by_vocabulary(symbols, distinct)
    listed = sorted(row.term for row in few)
    numbered = symbols.sparkSession.createDataFrame(list(enumerate(listed)), "_no int, term string")

    def words(column: str) -> Column:
        found = F.array_distinct(fields(F.lower(F.col(column))))
        return F.coalesce(F.array_join(found, "\n"), F.lit("")).alias(column)

    texts = F.collect_list(F.struct(words("name"), words("signature"), words("body")))
    by_id = symbols.groupBy("id").agg(texts.alias("_texts"))
    lines = [F.array_join(F.col("_texts")[c], "\n") for c in ("name", "signature", "body")]
    codes = by_id.select("id", F.explode(_terms_inside(listed)(*lines)).alias("_code"))
    weight = F.col("_code").bitwiseAND(F.lit(7))
    return codes.join(numbered, F.shiftright("_code", 3) == F.col("_no")).select("term", "id", weight.alias("weight"))


def _terms_inside(terms: list[str]) -> Callable[..., Column]:
    """Helper on words of the name, the signature and the body, one a line: 8 * number of a term + its best weight."""

    numbers = {term: no for no, term in enumerate(terms)}
    size = min(map(len, terms), default=1)
    sizes_from: dict[str, list[int]] = {}
    for start, length in sorted({(term[:size], len(term)) for term in terms}):
        sizes_from.setdefault(start, []).append(length)
    inside: dict[str, tuple[int, ...]] = {}

    def of_word(word: str) -> tuple[int, ...]:
        hits = inside.get(word)
        if hits is None:
            found = set()
            for i in range(len(word) - size + 1):
                for length in sizes_from.get(word[i : i + size], ()):
                    no = numbers.get(word[i : i + length])
                    if no is not None:
                        found.add(no)
            hits = tuple(found)
            if len(inside) < WORDS_KEPT:
                inside[word] = hits
        return hits

    def of(lines: str) -> set[int]:
        return set(chain.from_iterable(map(of_word, set(lines.split("\n")))))

    def run(names: pa.Array, signatures: pa.Array, bodies: pa.Array) -> pa.Array:
        out = []
        for row in zip(names, signatures, bodies, strict=True):
            name, signature, body = (of(lines.as_py()) for lines in row)
            codes = [no * 8 + NAME_WEIGHT for no in name]
            codes += [no * 8 + SIGNATURE_WEIGHT for no in signature - name]
            codes += [no * 8 + BODY_WEIGHT for no in body - signature - name]
            out.append(pa.array(codes, pa.int32()))
        sizes = np.cumsum([0, *map(len, out)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(sizes), pa.concat_arrays(out) if out else pa.array([], pa.int32()))

    return F.arrow_udf(run, "array<int>")


def _weights_by_vocabulary(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """The same for more terms than a task should hold: words and terms meet in joins."""

    def words_of(column: str, weight: int) -> Column:
        return F.transform(
            F.array_distinct(fields(F.lower(F.col(column)))),
            lambda w: F.struct(w.alias("word"), F.lit(weight).alias("weight")),
        )

    words = symbols.select(
        "id",
        F.inline(
            F.concat(
                words_of("name", NAME_WEIGHT),
                words_of("signature", SIGNATURE_WEIGHT),
                words_of("body", BODY_WEIGHT),
            )
        ),
    ).where(F.octet_length("word") >= MIN_TERM_BYTES)
    matches = substring_matches(terms, words.select("word").distinct())
    return (
        words.join(matches, "word")
        .repartition("id")
        .groupBy("term", "id")
        .agg(F.max("weight").alias("weight"))
    )


def term_hits(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Keyword weight of each (request, term, symbol) with a hit: (request_id, id, hits).

    All rows of a symbol stand in one task, where a following sum takes them together before it shuffles.
    """
    terms = request_terms(requests)
    hits = (F.col("weight") * F.col("times")).alias("hits")
    return term_weights(symbols, terms).join(terms, "term").select("request_id", "id", hits)


def keyword_hits(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Summed keyword weight of each (request, symbol) with at least one hit.

    The weights are spread by symbol, which serves both aggregations: as long as the terms of the
    requests fit a broadcast, nothing is shuffled again on the way from words to sums.
    """
    return term_hits(requests, symbols).groupBy("request_id", "id").agg(F.sum("hits").alias("hits"))


def keyword_score(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Keyword weight over the number of all query words."""
    sizes = requests.select("request_id", F.size(query_words(F.col("query"))).alias("n_words"))
    return (
        keyword_hits(requests, symbols)
        .join(sizes, "request_id")
        .select("request_id", "id", (F.col("hits") / F.col("n_words")).alias("keyword_score"))
    )


def score_context(
    requests: DataFrame, symbols: DataFrame, links: Links, depth: int = MAX_DEPTH
) -> DataFrame:
    """Score and distance of every symbol with a positive score: (request_id, id, score, distance).

    Each kind of evidence arrives as rows of one shape; one aggregation adds them up, so symbols
    without any evidence for a request are never looked at together with it.
    """
    active = cursor_symbol(requests, symbols)
    opened = open_file_symbols(requests, symbols)
    distances = link_distance(active.unionByName(opened), links, depth)

    def evidence(df: DataFrame, **given: Column) -> DataFrame:
        blank = {
            "distance": F.lit(None).cast("int"),
            "hits": F.lit(None).cast("bigint"),
            "active": F.lit(False),
            "opened": F.lit(False),
        }
        return df.select("request_id", "id", *[given.get(n, c).alias(n) for n, c in blank.items()])

    rows = (
        evidence(distances, distance=F.col("distance"))
        .unionByName(evidence(term_hits(requests, symbols), hits=F.col("hits")))
        .unionByName(evidence(active, active=F.lit(True)))
        .unionByName(evidence(opened, opened=F.lit(True)))
    )
    sizes = requests.select("request_id", F.size(query_words(F.col("query"))).alias("n_words"))
    near = F.coalesce(F.lit(1.0) / (F.col("distance") + 1), F.lit(0.0))
    keyword = F.coalesce(F.col("hits") / F.nullif("n_words", F.lit(0)), F.lit(0.0))
    score = (
        near
        + keyword
        + F.when(F.col("active"), ACTIVE_BONUS).otherwise(0.0)
        + F.when(F.col("opened"), OPEN_BONUS).otherwise(0.0)
    )
    return (
        rows.groupBy("request_id", "id")
        .agg(
            F.min("distance").alias("distance"),
            F.sum("hits").alias("hits"),
            F.max("active").alias("active"),
            F.max("opened").alias("opened"),
        )
        .join(sizes, "request_id")
        .select(
            "request_id",
            "id",
            score.alias("score"),
            F.coalesce("distance", F.lit(-1)).alias("distance"),
        )
        .where(F.col("score") > 0)
    )


def _order(df: DataFrame) -> DataFrame:
    return df.withColumn("_score", F.round("score", SCORE_DIGITS))


def rank_by_window(scored: DataFrame) -> DataFrame:
    """Rank inside each request with one window group per request."""
    order = W.partitionBy("request_id").orderBy(F.desc("_score"), "id")
    return _order(scored).withColumn("rank", F.row_number().over(order).cast("bigint")).drop("_score")


def rank_by_range(scored: DataFrame) -> DataFrame:
    """The same ranks from one distributed sort, for requests too big for one task.

    Rows are range-partitioned and sorted by (request, score, id); a row's place is its partition's
    offset plus its place there, and its rank is that minus where its request begins. The sorted rows
    are written out first, because places must not be computed twice from different splits.
    """
    order = [F.col("request_id"), F.desc("_score"), F.col("id")]
    placed = cut_lineage(
        _order(scored)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_spot", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_spot", 33))
        .withColumn("_spot", F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # One row per partition and one per (partition, request) at its ends: small whatever the data.
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = parts.select(
        "_part",
        (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_offset"),
    )
    located = placed.join(offsets, "_part").withColumn("_place", F.col("_offset") + F.col("_spot"))
    starts = located.groupBy("request_id").agg(F.min("_place").alias("_start"))
    return (
        located.join(starts, "request_id")
        .withColumn("rank", F.col("_place") - F.col("_start") + 1)
        .select(*scored.columns, "rank")
    )


def rank_order(scored: DataFrame, largest_request: int) -> DataFrame:
    """Add ``rank`` (1..n per request): score descending, then id.

    ``largest_request`` bounds the rows of one request, e.g. the number of symbols.
    """
    return rank_by_window(scored) if largest_request <= WINDOW_ROWS else rank_by_range(scored)


def rank_context(
    requests: DataFrame, symbols: DataFrame, links: Links, depth: int = MAX_DEPTH, scored: DataFrame | None = None
) -> DataFrame:
    """Ranked symbols per request: (request_id, id, score, distance, rank).

    ``scored`` is the outcome of ``score_context`` where the caller has written it, and with that has dropped its shuffles.
    """
    if scored is None:
        scored = score_context(requests, symbols, links, depth)
    return rank_order(scored, symbols.count())


def included_symbols(ranked: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """Ids in rank order, in arrays of at most ``block``: (request_id, block, ids)."""
    return (
        ranked.withColumn("block", F.floor((F.col("rank") - 1) / block).cast("int"))
        .groupBy("request_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("rows"))
        .select("request_id", "block", F.col("rows.id").alias("ids"))
    )
