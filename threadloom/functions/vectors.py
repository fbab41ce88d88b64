"""Vector expressions on array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.let import let

EMBEDDING_DIMS = 1536


def _dot(a: Column, b: Column) -> Column:
    """Single-precision products summed in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda acc, p: acc + p
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero for empty, unequal or zero-norm vectors."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, F.coalesce(_dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))).otherwise(
        F.lit(0.0)
    )


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""

    def scaled(u: Column) -> Column:
        squares = F.aggregate(u, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        return let(
            F.sqrt(squares),
            lambda norm: F.when(norm > 0, F.transform(u, lambda x: (x / norm).cast("float"))).otherwise(u),
        )

    return let(v, scaled)


def hash_embedding(text: Column, dims: int = EMBEDDING_DIMS) -> Column:
    """Deterministic unit vector drawn from hashes of the text; null for a null text."""
    raw = let(
        F.xxhash64(text),
        lambda seed: F.transform(
            F.sequence(F.lit(1), F.lit(dims)),
            lambda i: (F.xxhash64(seed, i) / F.lit(float(2**63))).cast("float"),
        ),
    )
    return F.when(text.isNotNull(), l2_normalize(raw))
