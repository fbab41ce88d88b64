"""Vector tables: upsert, index build, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.hashing import vector_id
from threadloom.functions.text import embed_preview
from threadloom.functions.vectors import cosine, hash_embedding

QUERY_BLOCK_ROWS = 8192
VECTOR_BLOCK_ROWS = 16384
BLOCK_GROWTH = 4  # blocks of large tables have at most as many times those rows
BLOCKS = 8  # blocks per side from which on they grow instead of becoming more
PRODUCT_CELLS = 1 << 23  # similarities of one matrix product, 64 MB
SLACK = 1e-6  # far above the rounding difference between the two ways to compute a score


def vector_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row per id; the highest ``batch`` wins, among equal ones the highest hash of the row."""
    both = existing.unionByName(new)
    rest = [c for c in both.columns if c not in ("id", "batch")]
    order = F.struct("batch", F.xxhash64(F.to_json(F.struct(*rest))))
    return (
        both.groupBy("id")
        .agg(F.max_by(F.struct("batch", *rest), order).alias("row"))
        .select("id", "row.batch", *[f"row.{c}" for c in rest])
    )


def vector_index(
    symbols: DataFrame, embed: Callable[[Column], Column] = hash_embedding
) -> DataFrame:
    """Vector records of symbols; rows whose embedding failed (null) are dropped.

    ``embed`` maps a text column to an array<float> column: a native expression or a pandas UDF.
    """
    return symbols.select(
        vector_id(F.col("id")).alias("id"),
        embed(embed_preview(F.col("signature"), F.col("body"))).alias("vector"),
        F.create_map(
            F.lit("id"), "id", F.lit("name"), "name", F.lit("type"), "type", F.lit("file_path"), "file_path"
        ).alias("payload"),
    ).where(F.col("vector").isNotNull())


def vector_topk(vectors: DataFrame, probe: list[float], k: int) -> DataFrame:
    """The ``k`` vectors most similar to one probe: a distributed top-k, no full sort."""
    target = F.array(*[F.lit(float(x)).cast("float") for x in probe])
    return (
        vectors.withColumn("score", cosine(F.col("vector"), target)).orderBy(F.desc("score"), "id").limit(k)
    )


def _unit_rows(vectors: list[np.ndarray]) -> np.ndarray:
    rows = np.stack(vectors).astype(np.float32)
    norm = np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros(rows.shape), where=norm > 0)


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    dot = (a * b).astype(np.float64).sum()
    norm = np.sqrt((a * a).astype(np.float64).sum()) * np.sqrt((b * b).astype(np.float64).sum())
    return float(dot / norm) if norm > 0 else 0.0


def _block_best(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Best ``k`` of one block of vectors for each of one block of queries."""

    def best(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        ids = vectors["id"].to_numpy()
        width_v = vectors["vector"].map(len).to_numpy()
        right = {
            width: (at := np.flatnonzero(width_v == width), _unit_rows([vectors["vector"].iloc[i] for i in at]))
            for width in set(width_v) - {0}
        }
        out = []
        at_once = max(PRODUCT_CELLS // max(len(vectors), 1), 1)
        for start in range(0, len(queries), at_once):
            some = queries.iloc[start : start + at_once]
            width_q = some["probe"].map(len).to_numpy()
            # Other widths stay at similarity 0.
            score = np.zeros((len(some), len(vectors)))
            for width in set(width_q) & set(right):
                qi, (vi, units) = np.flatnonzero(width_q == width), right[width]
                left = _unit_rows([some["probe"].iloc[i] for i in qi])
                score[np.ix_(qi, vi)] = left @ units.T
            for row, (query, probe) in enumerate(zip(some["query_id"], some["probe"])):
                line = score[row]
                # A matrix product finds the candidates, ties and near ties included; they are then
                # scored with single-precision products like the column expression.
                floor = np.partition(line, -k)[-k] - SLACK if k < len(line) else -np.inf
                near = np.flatnonzero(line >= floor)
                a = np.asarray(probe, dtype=np.float32)
                exact = np.array(
                    [
                        _exact(a, np.asarray(vectors["vector"].iloc[i], dtype=np.float32))
                        if width_v[i] == len(a) > 0
                        else 0.0
                        for i in near
                    ]
                )
                for i in np.lexsort((ids[near], -exact))[:k]:
                    out.append((query, ids[near[i]], exact[i]))
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    return best


def block_rows(rows: int, least: int) -> int:
    """Rows of a block: ``least`` for up to ``BLOCKS`` blocks, then more, up to ``BLOCK_GROWTH`` times as many."""
    return min(max(least, ceil(rows / BLOCKS)), BLOCK_GROWTH * least)


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    query_block: int | None = None,
    vector_block: int | None = None,
) -> DataFrame:
    """Exact ``k`` nearest ``vectors(id, vector)`` of each of ``queries(query_id, probe)``.

    Both sides are cut into blocks of bounded size by hash, every block of queries meets every block of
    vectors in one task as a matrix product, and only its best ``k`` per query leave the task. A final
    window keeps the best ``k`` of those. Ties go to the smaller id. Neither side is broadcast. Unless given, the sizes of
    the blocks grow with the tables up to a bound: every row travels once per block of the other side.
    """
    n_queries, n_vectors = queries.count(), vectors.count()
    query_blocks = max(ceil(n_queries / (query_block or block_rows(n_queries, QUERY_BLOCK_ROWS))), 1)
    vector_blocks = max(ceil(n_vectors / (vector_block or block_rows(n_vectors, VECTOR_BLOCK_ROWS))), 1)

    def blocked(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(n_own))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint")))
        )

    q = blocked(queries.select("query_id", "probe"), "qb", query_blocks, "vb", vector_blocks)
    v = blocked(vectors.select("id", "vector"), "vb", vector_blocks, "qb", query_blocks)
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}
    found = (
        q.groupBy("qb", "vb")
        .cogroup(v.groupBy("qb", "vb"))
        .applyInPandas(
            _block_best(k), f"query_id {kind['query_id']}, id {kind['id']}, score double"
        )
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
