"""Symbols, imports and calls from source text, one row per file in, many rows out.

Declarations are found line by line with patterns per language. Everything about a file happens in its
own row: no shuffle, and the text never leaves the JVM (only numbers per line do, to find block ends).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.blocks import (
    block_body,
    block_ends,
    indent_level,
    is_blank_or_hash,
    lines,
    net_braces,
    open_braces,
)
from threadloom.functions.hashing import content_sha256, symbol_id
from threadloom.functions.paths import language
from threadloom.functions.text import trim_space
from threadloom.schemas import SYMBOLS

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Import patterns; every group is one way to name the module.
IMPORTS = {
    "java": r"^\s*import\s+(?:static\s+)?([\w\.\*]+);",
    "python": r"^\s*(?:import\s+([\w\s,]+)|from\s+([\w\.]+)\s+import\s+([\w\s,\*]+))",
    "javascript": (
        r"^\s*(?:import\s+.*?\s+from\s+['\"](.*?)['\"]|const\s+.*?\s+=\s+require\(['\"](.*?)['\"]\))"
    ),
    "csharp": r"^\s*using\s+([\w\.\s=]+);",
}
# Class-like declarations, \b for an ASCII word boundary.
CLASSES = {
    "java": r"\b(?:class|interface|enum|record)\s+([A-Za-z0-9_]+)",
    "python": r"^\s*class\s+([A-Za-z0-9_]+)",
    "javascript": r"\bclass\s+([A-Za-z0-9_]+)",
    "typescript": r"\b(?:class|interface|enum)\s+([A-Za-z0-9_]+)",
    "csharp": r"\b(?:class|interface|struct|enum|record)\s+([A-Za-z0-9_]+)",
    "kotlin": r"\b(?:class|interface|object|enum\s+class)\s+([A-Za-z0-9_]+)",
}
# Function declarations; the first group that matched is the name.
FUNCTIONS = {
    "java": (
        r"\b(?:public|protected|private|static|\s++)+[\w<>\[\]]+\s+([A-Za-z0-9_]+)"
        r"\s*\([^\)]*\)\s*(?:throws\s+[\w\s,]+)?\s*\{"
    ),
    "python": r"^\s*def\s+([A-Za-z0-9_]+)\s*\(",
    "javascript": (
        r"(?:function\s+([A-Za-z0-9_]+)\b|([A-Za-z0-9_]+)\s*\([^\)]*\)\s*\{"
        r"|\b([A-Za-z0-9_]+)\s*=\s*(?:\([^\)]*\)|[A-Za-z0-9_]+)\s*=>)"
    ),
    "typescript": (
        r"(?:function\s+([A-Za-z0-9_]+)\b|([A-Za-z0-9_]+)\s*\([^\)]*\)\s*(?::\s*[\w<>|]+)?\s*\{"
        r"|\b([A-Za-z0-9_]+)\s*=\s*(?:\([^\)]*\)|[A-Za-z0-9_]+)\s*=>)"
    ),
    "csharp": (
        r"\b(?:public|protected|private|static|internal|override|\s++)+[\w<>\[\]]+\s+([A-Za-z0-9_]+)"
        r"\s*\([^\)]*\)\s*(?:\{|=>)"
    ),
    "kotlin": r"\bfun\s+(?:<[\w\s,]+>\s+)?(?:[\w\.]+\.)?([A-Za-z0-9_]+)\s*\(",
}
GROUPS = {"javascript": 3, "typescript": 3}
# A line without any of these cannot match; spares the pattern on most lines.
_CLASS_HINTS = {
    "java": ["class", "interface", "enum", "record"],
    "python": ["class"],
    "javascript": ["class"],
    "typescript": ["class", "interface", "enum"],
    "csharp": ["class", "interface", "struct", "enum", "record"],
    "kotlin": ["class", "interface", "object"],
}
_FUNCTION_HINTS = {
    "java": ["("],
    "python": ["def"],
    "javascript": ["(", "function", "=>"],
    "typescript": ["(", "function", "=>"],
    "csharp": ["("],
    "kotlin": ["fun"],
}
# Control words that the function patterns of brace languages also match.
CONTROL_WORDS = ["if", "for", "while", "switch", "catch", "with"]

# Words of Go that may stand before a parenthesis without being a call.
GO_WORDS = ["func", "if", "for", "switch", "select", "return", "range", "go", "defer", "case", "type",
            "var", "const", "else", "interface", "struct", "map", "chan"]
# String and rune literals and comments within a line.
_GO_NOISE = (
    r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|`[^`]*+`|'[^'\\]*+(?:\\.[^'\\]*+)*+'|//.*$|/\*.*?\*/"
)
_GO_TYPE = r"^\s*type\s+([A-Za-z_]\w*)"
_GO_FUNC = r"^func\s+(?:\(([^)]*)\)\s*)?([A-Za-z_]\w*)"
_CALL = r"(?<![\w.])((?:[A-Za-z_]\w*\.)?[A-Za-z_]\w*)\("


def _pattern(table: dict[str, str], lang: str) -> str:
    return table[lang].replace(r"\b", _EDGE)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


# ---------------------------------------------------------------- imports


def _line_imports(all_lines: Column, lang: str) -> Column:
    pattern = _pattern(IMPORTS, lang)

    def found(line: Column) -> Column:
        first = F.regexp_extract(line, pattern, 1)
        if lang == "python":
            source = F.regexp_extract(line, pattern, 2)
            item = F.concat(source, F.lit("."), F.regexp_extract(line, pattern, 3))
            first = F.when(first != "", first).when(source != "", item).otherwise("")
        elif lang == "javascript":
            first = F.when(first != "", first).otherwise(F.regexp_extract(line, pattern, 2))
        return trim_space(first)

    return F.filter(F.transform(all_lines, found), lambda m: m != "")


def _go_imports(content: Column) -> Column:
    blocks = F.regexp_extract_all(content, F.lit(r"(?ms)^import\s*\((.*?)\)"), F.lit(1))
    listed = F.flatten(
        F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"\"([^\"]+)\""), F.lit(1)))
    )
    single = F.regexp_extract_all(
        content, F.lit(r"(?m)^import\s+(?:[\w.]+\s+)?\"([^\"]+)\""), F.lit(1)
    )
    return F.concat(listed, single)


def imports(content: Column, lang: Column) -> Column:
    """Imported modules in order of appearance."""
    all_lines = lines(content)
    return (
        F.when(lang == "go", _go_imports(content))
        .when(lang.isin("java", "kotlin"), _line_imports(all_lines, "java"))
        .when(lang == "python", _line_imports(all_lines, "python"))
        .when(
            lang.isin("javascript", "typescript", "typescriptreact", "javascriptreact"),
            _line_imports(all_lines, "javascript"),
        )
        .when(lang == "csharp", _line_imports(all_lines, "csharp"))
        .otherwise(_empty("string"))
    )


# ---------------------------------------------------------------- files


def _go_line(line: Column) -> Column:
    """Line without literals, comments and empty type literals, for counting braces."""
    bare = F.regexp_replace(line, _GO_NOISE, "")
    return F.regexp_replace(bare, r"\b(interface|struct) ?\{\}", "$1")


def parse_status(content: Column, lang: Column) -> Column:
    """``ok``, or ``error`` for Go text without a package line or with unbalanced braces."""
    balance = F.aggregate(
        lines(content), F.lit(0), lambda acc, line: acc + net_braces(_go_line(line))
    )
    broken = ~content.rlike(r"(?m)^package\s+\w+") | (balance != 0)
    return F.when((lang == "go") & broken, "error").otherwise("ok")


def describe_files(sources: DataFrame) -> DataFrame:
    """Files of supported languages with hash, language, imports, status; keeps the content."""
    path, content = F.col("file_path"), F.col("content")
    return (
        sources.withColumn("language", language(path))
        .where(F.col("language") != "unknown")
        .withColumns(
            {
                "sha256": content_sha256(content),
                "imports": imports(content, F.col("language")),
                "parse_status": parse_status(content, F.col("language")),
            }
        )
        .select("file_path", "sha256", "language", "imports", "parse_status", "content")
    )


# ---------------------------------------------------------------- symbols


def _found(all_lines: Column, kind: str, table: dict[str, str], lang: str) -> Column:
    """Name, line number, kind and line of every declaration; other lines have an empty name."""
    pattern = _pattern(table, lang)
    groups = GROUPS.get(lang, 1) if table is FUNCTIONS else 1
    hints = (_FUNCTION_HINTS if table is FUNCTIONS else _CLASS_HINTS)[lang]

    def one(line: Column, index: Column) -> Column:
        name = F.concat(*[F.regexp_extract(line, pattern, g + 1) for g in range(groups)])
        possible = reduce(or_, [line.contains(h) for h in hints])
        return F.struct(
            F.when(possible, name).otherwise("").alias("name"),
            (index + 1).alias("line"),
            F.lit(kind).alias("type"),
            line.alias("signature"),
        )

    return F.filter(F.transform(all_lines, one), lambda d: d["name"] != "")


def _general(all_lines: Column, lang: str, drop_keywords: bool) -> Column:
    both = F.concat(
        _found(all_lines, "class", CLASSES, lang), _found(all_lines, "function", FUNCTIONS, lang)
    )
    if not drop_keywords:
        return both
    return F.filter(both, lambda d: ~((d["type"] == "function") & d["name"].isin(CONTROL_WORDS)))


def _go(all_lines: Column) -> Column:
    def type_spec(line: Column, index: Column) -> Column:
        name = F.regexp_extract(line, _GO_TYPE, 1)
        form = F.regexp_extract(line, _GO_TYPE + r"(?:\[[^\]]*\])?\s+(struct|interface)\b", 2)
        kind = F.when(form == "interface", "interface").otherwise("struct")
        sig = F.concat(F.lit("type "), name, F.when(form != "", F.concat(F.lit(" "), form)).otherwise(""))
        return F.struct(
            name.alias("name"), (index + 1).alias("line"), kind.alias("type"), sig.alias("signature")
        )

    def func(line: Column, index: Column) -> Column:
        receiver = F.regexp_extract(
            F.regexp_extract(line, _GO_FUNC, 1), r"(?:^|\s)\*?([A-Za-z_]\w*)\s*$", 1
        )
        plain = F.regexp_extract(line, _GO_FUNC, 2)
        is_method = F.regexp_extract(line, r"^func\s+(\()", 1) != ""
        kind = F.when(is_method, "method").otherwise("function")
        full = F.when((plain != "") & (receiver != ""), F.concat(receiver, F.lit("."), plain))
        return F.struct(
            F.coalesce(full, plain).alias("name"),
            (index + 1).alias("line"),
            kind.alias("type"),
            line.alias("signature"),
        )

    both = F.concat(F.transform(all_lines, type_spec), F.transform(all_lines, func))
    return F.filter(both, lambda d: d["name"] != "")


def declarations(files: DataFrame, drop_keywords: bool = False) -> DataFrame:
    """Every declaration with its block, before duplicates are dropped.

    Output: the columns of a symbol plus ``language``. The result holds one row per declaration.
    """
    text = files.where(F.col("parse_status") == "ok").select(
        "file_path", "language", lines(F.col("content")).alias("lines")
    )
    lang, all_lines = F.col("language"), F.col("lines")
    found = F.when(lang == "go", _go(all_lines))
    for name in CLASSES:
        found = found.when(lang == name, _general(all_lines, name, drop_keywords))
    # No filter on the found ones here: it would be pushed down and find them a second time.
    located = text.withColumns(
        {
            "found": found,
            "code": F.when(lang == "go", F.transform(all_lines, _go_line)).otherwise(all_lines),
        }
    )
    by_brace = lang != "python"
    code = F.col("code")
    levels = F.when(by_brace, F.transform(code, net_braces)).otherwise(F.transform(code, indent_level))
    flags = F.when(by_brace, F.transform(code, lambda x: open_braces(x) > 0)).otherwise(
        F.transform(code, is_blank_or_hash)
    )
    ended = located.withColumn("ends", block_ends(by_brace, levels, flags))

    def symbol(d: Column) -> Column:
        header = F.element_at(F.col("code"), d["line"])
        is_go_type = (lang == "go") & d["type"].isin("struct", "interface")
        end = F.when(is_go_type & (open_braces(header) == 0), d["line"]).otherwise(
            F.element_at(F.col("ends"), d["line"])
        )
        return F.struct(
            d["name"].alias("name"),
            d["type"].alias("type"),
            d["line"].alias("line_start"),
            end.alias("line_end"),
            F.when(lang == "go", d["signature"]).otherwise(trim_space(d["signature"])).alias("signature"),
            block_body(all_lines, d["line"], end).alias("body"),
        )

    rows = ended.select("file_path", "language", F.inline(F.transform("found", symbol)))
    return _go_texts(rows).select(
        symbol_id(F.col("file_path"), F.col("name")).alias("id"),
        "name",
        "type",
        "file_path",
        "line_start",
        "line_end",
        "signature",
        "body",
        "dependencies",
        "language",
    )


def call_refs(code: Column) -> Column:
    """Names called as ``f(`` or ``x.f(``; longer chains are left out, repeats are kept."""
    found = F.regexp_extract_all(code, F.lit(_CALL), F.lit(1))
    return F.filter(found, lambda n: ~n.isin(GO_WORDS))


def _go_texts(rows: DataFrame) -> DataFrame:
    """Signature, body and calls of Go symbols; other languages pass through."""
    go, body = F.col("language") == "go", F.col("body")
    is_type = F.col("type").isin("struct", "interface")
    # A type starts at its name; its last line ends at the closing brace or before a comment.
    type_body = F.regexp_replace(
        F.regexp_replace(body, r"^\s*type\s+", ""), r"(?<=\})[^}\n]*$|\s*//[^\n]*$", ""
    )
    head = F.regexp_extract(body, r"(?s)^(.*?(?<!interface)(?<!interface )(?<!struct)(?<!struct )\{)", 1)
    after = F.regexp_replace(body.substr(F.char_length(head) + 1, F.char_length(body)), "(?m)" + _GO_NOISE, "")
    no_body = head == ""
    bare = F.concat(
        F.lit("func "),
        F.when(F.col("type") == "method", F.concat(F.lit("("), F.substring_index("name", ".", 1), F.lit(") ")))
        .otherwise(""),
        F.substring_index("name", ".", -1),
    )
    return rows.withColumns(
        {
            "signature": F.when(~go | is_type, F.col("signature"))
            .when(no_body, bare)
            .otherwise(trim_space(head)),
            "body": F.when(go & is_type, type_body).when(go & no_body, "").otherwise(body),
            "dependencies": F.when(go & ~is_type, call_refs(after)).otherwise(_empty("string")),
        }
    )


def dedupe_last_wins(declared: DataFrame) -> DataFrame:
    """One symbol per id: the last declaration, a function before a class on the same line."""
    rank = F.struct(F.col("line_start"), (F.col("type") != "class").cast("int"))
    rest = [c for c in declared.columns if c != "id"]
    return (
        declared.groupBy("id").agg(F.max_by(F.struct(*rest), rank).alias("row")).select("id", "row.*")
    )


def extract_symbols(
    files: DataFrame,
    drop_keywords: bool = False,
    extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Symbols of all files.

    ``extra`` plugs in further extractors by language: each maps (file_path, content) rows to rows of
    the symbol schema, for instance with ``mapInPandas``.
    """
    names = [f.name for f in SYMBOLS]
    out = dedupe_last_wins(declarations(files, drop_keywords)).select(*names)
    for lang, extractor in (extra or {}).items():
        own = files.where(F.col("language") == lang).select("file_path", "content")
        out = out.unionByName(extractor(own).select(*names))
    return out
