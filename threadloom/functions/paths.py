"""Path expressions: language, fence tag, directory, package."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language.
LANGUAGES = {
    ".go": "go",
    ".java": "java",
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescriptreact",
    ".jsx": "javascriptreact",
    ".cs": "csharp",
    ".kt": "kotlin",
    ".kts": "kotlin",
}

# File extension -> tag of a fenced block (differs from LANGUAGES for jsx, tsx, kts).
FENCES = {
    "go": "go",
    "py": "python",
    "java": "java",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "cs": "csharp",
    "kt": "kotlin",
}


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(mapping, key), F.lit(default))


def language(path: Column) -> Column:
    """Language from the extension of the last path element, else ``unknown``."""
    return _lookup(LANGUAGES, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)), "unknown")


def fence(path: Column) -> Column:
    """Fence tag from whatever follows the last dot of the path, else empty."""
    return _lookup(FENCES, F.lower(F.substring_index(path, ".", -1)), "")


def directory(path: Column) -> Column:
    """Directory of a cleaned path; ``.`` when there is none."""
    head = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return (
        F.when(~path.contains("/"), F.lit("."))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def last_segment(path: Column) -> Column:
    """Text after the last slash (the root slash stands for itself)."""
    return F.when(path == "/", path).otherwise(F.substring_index(path, "/", -1))


def package(path: Column) -> Column:
    """Base name of the directory of a path."""
    return last_segment(directory(path))


def is_hidden(relative_path: Column) -> Column:
    """True when any element of the path starts with a dot."""
    return relative_path.rlike(r"(^|/)\.[^/]")


def simple_name(name: Column) -> Column:
    """Last dot-separated segment of a qualified name."""
    return F.substring_index(name, ".", -1)
