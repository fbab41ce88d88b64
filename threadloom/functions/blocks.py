"""Line and block expressions for source text."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import trim_space

TAB_WIDTH = 4


def lines(content: Column) -> Column:
    return F.split(content, "\n")


def _occurrences(text: Column, char: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(char), F.lit("")))


def open_braces(line: Column) -> Column:
    return _occurrences(line, "{")


def net_braces(line: Column) -> Column:
    return _occurrences(line, "{") - _occurrences(line, "}")


def indent_level(line: Column) -> Column:
    """Leading white space: one per space, four per tab."""
    lead = F.regexp_extract(line, r"^[ \t]*", 0)
    return F.char_length(lead) + (TAB_WIDTH - 1) * _occurrences(lead, "\t")


def is_blank_or_hash(line: Column) -> Column:
    bare = trim_space(line)
    return (bare == "") | bare.startswith("#")


class _Below:
    """Lines seen so far on a walk upwards; finds the nearest one at or under a level.

    A line hidden by a nearer one of the same or a lower level is dropped, so the levels rise towards
    the nearest line and a binary search does.
    """

    def __init__(self) -> None:
        self.levels: list[int] = []
        self.numbers: list[int] = []

    def add(self, number: int, level: int) -> None:
        while self.levels and self.levels[-1] >= level:
            self.levels.pop()
            self.numbers.pop()
        self.levels.append(level)
        self.numbers.append(number)

    def nearest(self, level: int, default: int) -> int:
        k = bisect_right(self.levels, level)
        return self.numbers[k - 1] if k else default


def brace_ends(net: list[int], opened: list[bool]) -> list[int]:
    """Per start line: first line with a brace opened since the start and the balance back at zero."""
    size = len(net)
    balance = [0, *accumulate(net)]  # balance[i] is the one before line i + 1
    below = _Below()
    ends = [size] * size
    waiting: dict[int, list[int]] = {}
    first_open = None
    for start in range(size, 0, -1):
        first_open = start if opened[start - 1] else first_open
        if first_open is not None:
            waiting.setdefault(first_open, []).append(start)
    for line in range(size, 0, -1):
        below.add(line, balance[line])
        for start in waiting.get(line, ()):
            ends[start - 1] = below.nearest(balance[start - 1], size)
    return ends


def indent_ends(indent: list[int], skipped: list[bool]) -> list[int]:
    """Per start line: the line before the next one that is not indented deeper."""
    size = len(indent)
    below = _Below()
    ends = [size] * size
    for line in range(size, 0, -1):
        if skipped[line - 1]:
            continue
        ends[line - 1] = below.nearest(indent[line - 1], size + 1) - 1
        below.add(line, indent[line - 1])
    return ends


def block_ends(by_brace: Column, levels: Column, flags: Column) -> Column:
    """Last line of the block that starts at each line (1-based), in one pass per file.

    ``levels`` and ``flags`` are the net braces and whether one opens, or the indents and whether the
    line is skipped.
    """

    @F.pandas_udf("array<int>")
    def ends(brace: pd.Series, level: pd.Series, flag: pd.Series) -> pd.Series:
        return pd.Series(
            [
                (brace_ends if b else indent_ends)(list(map(int, x)), list(map(bool, f)))
                for b, x, f in zip(brace, level, flag)
            ]
        )

    return ends(by_brace, levels, flags)


def block_body(all_lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(all_lines, start, end - start + 1), "\n")
