"""Text expressions. Lengths are UTF-8 bytes unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.let import let
from threadloom.functions.paths import fence

MIN_TERM_BYTES = 3
PREVIEW_BYTES = 800
BYTES_PER_TOKEN = 4
DEFAULT_MAX_TOKENS = 4096
DEFAULT_PROVIDER = "ollama"
DEFAULT_MODEL = "codellama"
NO_DATABASE = "[local-in-memory fallback]"


def fields(text: Column) -> Column:
    """Words between runs of Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def trim_space(text: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def query_words(query: Column) -> Column:
    return fields(F.lower(query))


def query_terms(query: Column) -> Column:
    """Query words long enough to be matched."""
    return F.filter(query_words(query), lambda w: F.octet_length(w) >= MIN_TERM_BYTES)


def byte_prefix(text: Column, size: int) -> Column:
    """First ``size`` bytes, without a character cut in half at the end."""
    raw = F.encode(text, "UTF-8")

    def byte_at(i: int) -> Column:
        return F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")

    # The cut is clean when the next byte is no continuation byte (0x80..0xBF).
    cut = F.lit(size - 3)
    for end in (size - 2, size - 1, size):
        cut = F.when(~byte_at(end + 1).between(128, 191), F.lit(end)).otherwise(cut)
    return F.when(F.octet_length(text) <= size, text).otherwise(
        F.decode(raw.substr(F.lit(1), cut), "UTF-8")
    )


def embed_preview(signature: Column, body: Column) -> Column:
    return byte_prefix(F.concat(signature, F.lit("\n"), body), PREVIEW_BYTES)


def token_estimate(size_in_bytes: Column) -> Column:
    return F.floor(size_in_bytes / BYTES_PER_TOKEN).cast("int")


def savings_percent(raw: Column, optimized: Column) -> Column:
    """Share saved in percent, never below zero; zero when there was nothing."""
    share = (raw - optimized) / F.nullif(raw, F.lit(0)) * 100.0
    return F.when(raw > 0, F.greatest(F.lit(0.0), share)).otherwise(F.lit(0.0))


def clean_lines(code: Column, path: Column) -> Column:
    """Drop blank lines and full-line comments; elision markers stay."""
    marker = F.when(fence(path) == "python", F.lit("#")).otherwise(F.lit("//"))

    def keep(line: Column, mark: Column) -> Column:
        return let(
            trim_space(line),
            lambda bare: (bare != "") & (~bare.startswith(mark) | bare.contains("optimized out")),
        )

    return let(
        marker,
        lambda mark: F.array_join(F.filter(F.split(code, "\n"), lambda line: keep(line, mark)), "\n"),
    )


def skeleton(signature: Column, key: Column, path: Column, strip_brace: bool = False) -> Column:
    """Signature plus a marker that names the key of the left-out body."""
    note = F.concat(F.lit(" ... method body optimized out (CCR Key: "), key, F.lit(")"))
    head = F.regexp_replace(signature, r"\s*\{$", "") if strip_brace else signature
    braced = F.concat(head, F.lit(" {\n    //"), note, F.lit("\n}"))
    indented = F.concat(signature, F.lit("\n    #"), note)
    return F.when(fence(path) == "python", indented).otherwise(braced)


def mask_conn_str(conn: Column) -> Column:
    """Connection string with its password hidden, for display."""
    at = F.split(conn, "@")
    cred = F.split(at[0], ":")
    hidden = F.concat(cred[0], F.lit(":[MASKED]@"), at[1])
    return (
        F.when(conn == "", F.lit(NO_DATABASE))
        .when(conn.contains("@") & conn.contains(":") & (F.size(cred) > 2), hidden)
        .otherwise(conn)
    )


def entropy(text: Column) -> Column:
    """Shannon entropy in bits: counts per character over the byte length."""
    chars = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    size = F.octet_length(text).cast("double")

    def part(acc: Column, ch: Column) -> Column:
        p = (F.char_length(text) - F.char_length(F.replace(text, ch, F.lit("")))) / size
        return acc - p * F.log2(p)

    return F.aggregate(chars, F.lit(0.0), part)
