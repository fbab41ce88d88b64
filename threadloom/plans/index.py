"""Indexing: sources to files, symbols and links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.paths import is_hidden
from threadloom.operators.catalog import changed_files, unchanged_files
from threadloom.operators.extract import describe_files, extract_symbols
from threadloom.operators.linking import Links, link_symbols
from threadloom.session import cut_lineage


@dataclass(frozen=True)
class Index:
    files: DataFrame
    symbols: DataFrame
    links: Links


def visible(sources: DataFrame, root: str = "") -> DataFrame:
    """Sources without those that are hidden below ``root``."""
    return sources.where(~is_hidden(F.substring(F.col("file_path"), len(root) + 1, 2**31 - 1)))


def index_sources(sources: DataFrame, root: str = "") -> Index:
    """Index of ``sources(file_path, content)``; hidden paths below ``root`` and broken files are left out.

    The tables are written once: linking reads the symbols several times.
    """
    files = describe_files(visible(sources, root))
    symbols = cut_lineage(extract_symbols(files))
    good = cut_lineage(files.where(F.col("parse_status") == "ok").drop("content", "parse_status"))
    return Index(good, symbols, link_symbols(symbols, good))


def refresh_symbols(
    sources: DataFrame, previous_files: DataFrame, previous_symbols: DataFrame, root: str = ""
) -> DataFrame:
    """Symbols of the current sources, as ``index_sources`` finds them, extracting only new and changed files."""
    files = describe_files(visible(sources, root))
    kept = previous_symbols.join(
        unchanged_files(files, previous_files).select("file_path"), "file_path", "left_semi"
    )
    return extract_symbols(changed_files(files, previous_files)).unionByName(kept)
