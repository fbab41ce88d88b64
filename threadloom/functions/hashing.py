"""Content keys and deterministic hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CCR_KEY_HEX = 12
VECTOR_ID_HEX = 32


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def ccr_key(body: Column) -> Column:
    return F.substring(F.sha2(body, 256), 1, CCR_KEY_HEX)


def vector_id(symbol_id: Column) -> Column:
    return F.substring(F.sha2(symbol_id, 256), 1, VECTOR_ID_HEX)


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat_ws(":", path, name)


def poly_hash32(text: Column) -> Column:
    """h = 37, then h * 31 + byte modulo 2^32 over the UTF-8 bytes."""
    digits = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.aggregate(
        digits,
        F.lit(37).cast("bigint"),
        lambda h, b: (h * 31 + F.conv(b, 16, 10).cast("bigint")).bitwiseAND(F.lit(4294967295)),
    )
