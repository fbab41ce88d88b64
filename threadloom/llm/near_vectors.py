"""Near-duplicate embeddings by int8 quantised tile products with rigorous error bounds.

Vectors are scaled to length one and quantised to int8 with a scale of their own; the length of what the rounding left
over is kept as that vector's error. For codes ``p, q`` with errors ``e, f`` the cosine is within ``e + f + e * f`` of
their scaled product, so only pairs whose product comes that near to the threshold are computed again in double
precision. Products of codes are whole numbers below 2**24 and exact in float32.

Equal vectors are first joined to one row with a count. The rest is dealt over a grid of blocks; each pair of blocks is a
task that goes through its tiles and returns, for each vector, how many rows it links to and one link that connects it to
its part of the block pair: at most two rows a vector, never the pairs. Every vector travels to as many block pairs as
there are blocks, which is what comparing all pairs by tiles costs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different lengths
are never compared. Repeated ids are rows of their own that share the smallest id's component. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import components
from threadloom.session import cut_lineage

THRESHOLD = 0.95
BLOCK = 4096
TILE = 512
PAIRS = 65_536


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, and the length of the rounding error of unit vectors."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error + 1e-9


def links(a: np.ndarray, b: np.ndarray, threshold: float):
    """Index arrays of the pairs of raw vectors with a cosine of at least the threshold, tile by tile."""
    norms = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    coded = [quantise(x / n[:, None]) for x, n in zip((a, b), norms, strict=True)]
    (p, ps, pe), (q, qs, qe) = coded
    p32, q32 = p.astype(np.float32), q.astype(np.float32)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            product = (p32[i : i + TILE] @ q32[j : j + TILE].T) * (ps[i : i + TILE, None] * qs[None, j : j + TILE])
            slack = pe[i : i + TILE, None] + qe[None, j : j + TILE] + pe[i : i + TILE, None] * qe[None, j : j + TILE]
            x, y = np.nonzero(product + slack + 1e-6 >= threshold)
            x, y = x + i, y + j
            for k in range(0, len(x), PAIRS):
                u, v = x[k : k + PAIRS], y[k : k + PAIRS]
                cosine = (a[u] * b[v]).sum(1) / (norms[0][u] * norms[1][v])
                good = cosine >= threshold
                yield u[good], v[good]


def _block_pair(key: tuple, left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Weighted numbers of links of each vector of a block pair, and one link into each part it connects."""
    empty = pd.DataFrame({"vec": [], "n": [], "to": []}).astype("int64")
    if left.empty or right.empty:
        return empty
    same = key[0] == key[1]
    a, b = (np.stack(side["v"].to_numpy()).astype(np.float64) for side in (left, right))
    ids = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
    m = len(left)
    weight = left["n"].to_numpy(), right["n"].to_numpy()
    count = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in links(a, b, threshold):
        if same:
            x, y = x[x < y], y[x < y]
        np.add.at(count, x, weight[1][y])
        np.add.at(count, y + (0 if same else m), weight[0][x])
        y = y if same else y + m
        apart = root[x] != root[y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    linked = np.flatnonzero(count)
    if not len(linked):
        return empty
    return pd.DataFrame({"vec": ids[linked], "n": count[linked], "to": ids[[find(i) for i in linked.tolist()]]})


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``id, n_links, component`` for every row."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable, v))
    good = rows.where("v is not null").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    groups = cut_lineage(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    total = groups.count()
    blocks = max(1, -(-total // block))
    spread = groups.withColumn("b", F.pmod(F.xxhash64("id", F.size("v")), F.lit(blocks)).cast("int"))
    spread = spread.withColumn("size", F.size("v"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = spread.withColumn("o", every).where("b <= o").withColumnRenamed("b", "i").withColumnRenamed("o", "j")
    right = spread.withColumn("o", every).where("o <= b").withColumnRenamed("o", "i").withColumnRenamed("b", "j")
    grid = ["i", "j", "size"]
    met = (
        left.groupBy(*grid)
        .cogroup(right.groupBy(*grid))
        .applyInPandas(lambda k, a, b: _block_pair(k, a, b, threshold), "vec long, n long, to long")
    )
    met = cut_lineage(met)
    degree = met.groupBy("vec").agg(F.sum("n").alias("other"))
    root = components(met.select(F.col("vec").alias("a"), F.col("to").alias("b")))
    of_group = (
        groups.select("v", F.col("id").alias("vec"), "n")
        .join(degree, "vec", "left")
        .join(root.select(F.col("node").alias("vec"), "root"), "vec", "left")
        .select("v", (F.coalesce("other", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "vec").alias("component"))
    )
    linked = good.join(of_group, "v").select("id", "n_links", "component")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone)
