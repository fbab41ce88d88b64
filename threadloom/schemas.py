"""Table schemas of the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowed symbol kinds.
SYMBOL_KINDS = ["class", "interface", "method", "function", "variable", "import", "struct"]

_STR = T.StringType()
_STRS = T.ArrayType(_STR)
_HASHES = T.MapType(_STR, _STR)
_VECTOR = T.ArrayType(T.FloatType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


SOURCES = _table(file_path=_STR, content=_STR)
FILES = _table(file_path=_STR, sha256=_STR, language=_STR, imports=_STRS, parse_status=_STR)
SYMBOLS = _table(
    id=_STR,
    name=_STR,
    type=_STR,
    file_path=_STR,
    line_start=T.IntegerType(),
    line_end=T.IntegerType(),
    signature=_STR,
    body=_STR,
    dependencies=_STRS,
)
REQUESTS = _table(
    request_id=T.LongType(),
    query=_STR,
    open_files=_STRS,
    cursor_file=_STR,
    cursor_line=T.IntegerType(),
    max_tokens=T.IntegerType(),
)
VECTORS = _table(id=_STR, vector=_VECTOR, payload=_HASHES)
ANSWERS = _table(
    seq=T.LongType(),
    query=_STR,
    response=_STR,
    embedding=_VECTOR,
    file_hashes=_HASHES,
    created_at=T.TimestampType(),
)
CCR = _table(key=_STR, body=_STR)
AUDIT = _table(
    user_id=_STR,
    provider=_STR,
    model=_STR,
    raw_tokens=T.IntegerType(),
    optimized_tokens=T.IntegerType(),
    savings_percent=T.DoubleType(),
    duration_ms=T.IntegerType(),
    ts=T.TimestampType(),
)


def known_kind(kind: Column) -> Column:
    return kind.isin(SYMBOL_KINDS)
