"""Substring join: which words contain which terms, as equi-joins on character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

# Lengths of the grams; a term is looked up by the longest that fits it. Longer ones are far rarer.
GRAM_SIZES = [3, 4, 6, 8]
SHORT_SIZES = [1, 2]


def _grams(text: Column, size: int) -> Column:
    """All distinct substrings of ``size`` characters, found at every position by a look-ahead."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _term_grams(term: Column) -> Column:
    grams = F.array(term)
    for size in GRAM_SIZES:
        grams = F.when(F.char_length(term) >= size, _grams(term, size)).otherwise(grams)
    return grams


def substring_matches(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (term, word) with the non-empty term inside the word.

    ``terms(term)`` and ``words(word)`` are distinct vocabularies, so the work grows with the number
    of different words, not with the text. A term is looked up by the rarest of its grams; the pair is
    then checked with ``contains``. No pair is missed: a word holding the term holds all its grams.
    Grams below three characters are made only when some term is that short.
    """
    terms = terms.where(F.col("term") != "")
    short = not terms.where(F.char_length("term") < GRAM_SIZES[0]).isEmpty()
    sizes = SHORT_SIZES + GRAM_SIZES if short else GRAM_SIZES
    grams = F.flatten(F.array(*[_grams(F.col("word"), size) for size in sizes]))
    # Written tables have a known size, so the small side of each join is broadcast when it is small.
    term_grams = cut_lineage(terms.select("term", F.explode(_term_grams(F.col("term"))).alias("gram")))
    word_grams = cut_lineage(
        words.select("word", F.explode(grams).alias("gram")).join(
            term_grams.select("gram").distinct(), "gram", "left_semi"
        )
    )
    frequency = word_grams.groupBy("gram").agg(F.count("*").alias("n"))
    lookup = cut_lineage(
        term_grams.join(frequency, "gram")
        .groupBy("term")
        .agg(F.min(F.struct("n", "gram")).alias("best"))
        .select("term", F.col("best.gram").alias("gram"))
    )
    return cut_lineage(
        word_grams.join(lookup, "gram")
        .where(F.col("word").contains(F.col("term")))
        .select("term", "word")
    )
