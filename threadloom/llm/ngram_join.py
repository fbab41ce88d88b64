"""N-gram Jaccard join by a tree over count vectors.

A document is the set of its distinct shingles. Hashing the shingles into ``GROUPS`` groups makes it a point of group
counts; the summed minima of two points, or of the upper corners of two boxes of points, bound the overlap of the sets.
A plain R-tree over the points prunes next to nothing, since points of unlike texts of one length lie too close, so the
tree's first level is finer than a box: a branch for each shingle that two sets of the wanted similarity must share. By
the prefix rule such sets have one in common among the first ``n - ceil(0.8 n) + 1`` of each, in one order for all. Inside
a branch, boxes of points and then points are pruned by the bound, and what survives is verified on the sets.

The order puts shingles last whose bucket, of a fixed number, is frequent within some task. It is a matter of speed alone:
any order gives the same links. At most ``FREQUENT`` buckets travel to the tasks. A pair is looked at only where the shingles
that are left, from the branch's own on, suffice for the similarity; so it is at the first shingle that both have.

Links are needed for their classes only. So each branch first offers its members to its smallest one; whole groups of near
copies become one class by that, in as many pairs as the branch has members. Only branches that still hold several classes
go on to the tree, one branch for all that have the same members, and only pairs of different classes are looked at there, in
tiles of bounded size. The tree is gone through twice. The first time a task verifies only the nearest pairs that join its
classes, at most one less than it has classes; nearly all links are known by that. What the bounds let through between the
classes that are left is verified the second time, so no link is lost. Copies of one set are one node all along.

Null and empty texts and texts without words have an empty set and are a class of their own, whose id is the document's.
Texts shorter than a shingle have one shingle. Repeated rows share a class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import column, components, keyed, map_batches, may_have, record, word_digests
from threadloom.session import cut_lineage, release

WIDTH = 5
PERCENT = 80
GROUPS = 512
FREQUENT = 200_000
BUCKETS = 1 << 23  # 32 MB in a task
LOCAL = 8
TILE = 512
BOX = 16
LEAF = 2 * BOX

NONE = np.zeros(0, np.int64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For every text the sorted distinct 64-bit digests of the runs of ``WIDTH`` words, of all words where there are fewer."""
    words, starts = word_digests(texts, lower=True)
    total = np.full(max(len(words) - WIDTH + 1, 0), WIDTH, np.uint64)
    for j in range(WIDTH):
        total += words[j : j + len(total)] * _MIX[j]
    total = _scramble(total).view(np.int64)
    sets = []
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        n = end - start
        if n >= WIDTH:
            sets.append(np.unique(total[start : end - WIDTH + 1]))
        else:
            whole = np.full(min(n, 1), n, np.uint64)
            for j in range(n):
                whole += words[start + j : start + j + 1][: len(whole)] * _MIX[j]
            sets.append(_scramble(whole).view(np.int64))
    return sets


def shingles(text: bytes | None) -> np.ndarray:
    """The set of one text."""
    return shingle_sets(pa.array([text], pa.binary()))[0]


def _digest(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _sizes(docs: DataFrame) -> DataFrame:
    """``id, key, n, node`` per document; rows with a ``bucket`` and its number are where a task's frequent shingles fall.

    A task counts into ``BUCKETS`` numbers, whatever it reads.
    """

    def run(batches):
        seen = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            np.add.at(seen, np.concatenate([NONE, *sets]) & (BUCKETS - 1), 1)
            numbers = [[len(found) for found in sets], [_digest(found) for found in sets], [None] * len(sets)]
            yield record(["id", "key", "n", "node", "bucket"], [pa.array(x, pa.int64()) for x in (column(batch, "id"), column(batch, "key"), *numbers)])
        often = np.flatnonzero(seen >= LOCAL)
        nothing = pa.nulls(len(often), pa.int64())
        yield record(["id", "key", "n", "node", "bucket"], [nothing, nothing, seen[often].astype(np.int64), nothing, often])

    return cut_lineage(docs.mapInArrow(run, "id long, key long, n long, node long, bucket long"))


def _branches(docs: DataFrame, frequent: np.ndarray, often: np.ndarray) -> DataFrame:
    """``token, node, n, rest``: the first shingles of every set, the frequent ones last, and how many follow, itself included.

    Rows of equal sets repeat.
    """

    def run(batches):
        level = np.zeros(BUCKETS, np.uint8)
        level[frequent] = np.ceil(np.log2(often + 1))
        for batch in batches:
            tokens, nodes, sizes, rests = [NONE], [NONE], [NONE], [NONE]
            for found in shingle_sets(batch.column("text")):
                n = len(found)
                if not n:
                    continue
                take = n - -(-PERCENT * n // 100) + 1
                tokens.append(found[np.argsort(level[found & (BUCKETS - 1)], kind="stable")[:take]])
                nodes.append(np.full(take, _digest(found)))
                sizes.append(np.full(take, n))
                rests.append(np.arange(n, n - take, -1))
            values = [np.concatenate(x) for x in (tokens, nodes, sizes, rests)]
            yield record(["token", "node", "n", "rest"], [*values[:2], *(x.astype(np.int32) for x in values[2:])])

    return docs.select("text").mapInArrow(run, "token long, node long, n int, rest int")


def _enough(overlap: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether an overlap can reach the similarity: 100 i >= 80 (a + b - i)."""
    return overlap * (100 + PERCENT) >= PERCENT * total


def _near(overlap: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The similarity of an overlap, in millionths."""
    return overlap * 1_000_000 // (total - overlap)


def _points(counts) -> np.ndarray:
    """Group counts of the documents, a row each. A count is a byte, or four where the set has a larger one."""
    return np.array([np.frombuffer(c, "u1" if len(c) == GROUPS else "<u4") for c in counts], np.int32).reshape(-1, GROUPS)


def survivors(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
    """``a, b``: pairs of different classes that the bounds of boxes and points let through."""
    return _near_survivors(left, right, same)[["a", "b"]]


def _near_survivors(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
    """``a, b, near``: pairs of different classes that the bounds of boxes and points let through, with the similarity allowed."""
    sides = []
    for side in (left, right):
        side = side.sort_values(["n", "node"], ignore_index=True)
        points = _points(side["counts"])
        starts = np.arange(0, len(side), BOX)
        sides.append((side, points, np.maximum.reduceat(points, starts), side["n"].to_numpy()[starts], starts))
    (a, pa_, ahi, alo, astart), (b, pb, bhi, blo, bstart) = sides
    na, nb, ca, cb = (side[c].to_numpy(np.int64) for c in ("n", "root") for side in (a, b))
    ra, rb = (side["rest"].to_numpy(np.int64) for side in (a, b))
    out = [[], [], []]
    for i, start in enumerate(astart):
        boxes = np.flatnonzero(_enough(np.minimum(ahi[i], bhi).sum(1), alo[i] + blo))
        for x in range(start, min(start + BOX, len(a))):
            y = (bstart[boxes][:, None] + np.arange(BOX)).ravel()
            y = y[y < len(b)]
            y = y[(cb[y] != ca[x]) & _enough(np.minimum(ra[x], rb[y]), na[x] + nb[y])]
            if same:
                y = y[y > x]
            both = np.minimum(pa_[x], pb[y]).sum(1)
            good = _enough(both, na[x] + nb[y])
            y, both = y[good], both[good]
            out[0].append(np.full(len(y), a["node"][x]))
            out[1].append(b["node"].to_numpy()[y])
            out[2].append(_near(both, na[x] + nb[y]))
    u, v, near = (np.concatenate(side) if side else NONE for side in out)
    return pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v), "near": near}).drop_duplicates(["a", "b"])


_CELL = ["token", "i", "j"]


def _leaf_pairs(rows: pa.Table, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As ``_near_survivors`` for groups that are single leaves, all at once: ranges of rows, one group each."""
    n, rest, root, node = (rows[c].to_numpy().astype(np.int64) for c in ("n", "rest", "root", "node"))
    end = np.zeros(len(n), np.int64)
    for start, stop in zip(starts.tolist(), ends.tolist(), strict=True):
        end[start:stop] = stop
    out = [np.zeros((0, 2), np.int64)]
    at = np.arange(len(n))
    for step in range(1, LEAF):
        x = at[at + step < end]
        y = x + step
        good = (root[x] != root[y]) & _enough(np.minimum(rest[x], rest[y]), n[x] + n[y])
        out.append(np.stack([x[good], y[good]], 1))
    found = np.concatenate(out)
    used, places = np.unique(found, return_inverse=True)
    points = _points(rows["counts"].take(pa.array(used)).to_pylist())
    both, total = [NONE], n[found].sum(1)
    for part in np.array_split(places.reshape(-1, 2), len(found) // 4096 + 1):
        both.append(np.minimum(points[part[:, 0]], points[part[:, 1]]).sum(1))
    both = np.concatenate(both)
    good = _enough(both, total)
    return np.column_stack([np.sort(node[found[good]], 1), _near(both[good], total[good])])


def _forest(pairs: np.ndarray, rows: pa.Table) -> np.ndarray:
    """Of pairs ``a, b, near`` those that join two classes not yet joined by nearer ones: at most as many as there are classes."""
    node, root = (rows[c].to_numpy() for c in ("node", "root"))
    known, first = np.unique(node, return_index=True)
    classes, of_node = np.unique(root[first], return_inverse=True)
    ends = of_node[np.searchsorted(known, pairs[:, :2])]
    above, kept = list(range(len(classes))), []
    for i in np.argsort(-pairs[:, 2], kind="stable").tolist():
        x, y = ends[i].tolist()
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        if x != y:
            above[x] = y
            kept.append(i)
    return pairs[kept]


def _tree_pairs(batches: Iterator[pa.RecordBatch], forest: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs that are left of rows sorted by group; a group that goes on waits for the next batch.

    With ``forest``, only the nearest ones that join all classes of a batch that are joined by any.
    """
    waiting = None
    for batch in chain(batches, [None]):
        parts = [x for x in (waiting, batch) if x is not None and x.num_rows]
        if not parts:
            continue
        rows = pa.Table.from_batches(parts).combine_chunks()
        same = np.ones(rows.num_rows - 1, bool)
        for c in _CELL:
            values = rows[c].to_numpy()
            same &= values[1:] == values[:-1]
        starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
        ends = np.append(starts[1:], rows.num_rows)
        waiting = None
        if batch is not None:
            waiting = rows.slice(starts[-1]).combine_chunks().to_batches()[0]
            starts, ends = starts[:-1], ends[:-1]
        leaf = (ends - starts <= LEAF) & (rows["i"].to_numpy()[starts] == rows["j"].to_numpy()[starts])
        found = [_leaf_pairs(rows, starts[leaf], ends[leaf])]
        for start, end in zip(starts[~leaf].tolist(), ends[~leaf].tolist(), strict=True):
            group = rows.slice(start, end - start).to_pandas()
            left, right = group[~group["right"]], group[group["right"]]
            if group["i"][0] == group["j"][0]:
                found.append(_near_survivors(left, left, True).to_numpy(np.int64))
            elif len(left) and len(right):
                found.append(_near_survivors(left, right, False).to_numpy(np.int64))
        pairs = np.unique(np.concatenate(found), axis=0)
        if forest:
            pairs = _forest(pairs, rows)
        yield record(["a", "b"], [pairs[:, 0].copy(), pairs[:, 1].copy()])


def _nearest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tree_pairs(batches, forest=True)


def _bound(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs whose points allow the similarity."""

    def work(batch: pa.RecordBatch):
        x, y = (_points(column(batch, c)) for c in ("ca", "cb"))
        good = _enough(np.minimum(x, y).sum(1), x.sum(1) + y.sum(1)) if batch.num_rows else np.zeros(0, bool)
        yield record(["a", "b"], [batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))])

    a = points.select(F.col("node").alias("a"), F.col("counts").alias("ca"))
    b = points.select(F.col("node").alias("b"), F.col("counts").alias("cb"))
    return map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "ca", "cb"), work, "a long, b long")


def _verify(pairs: DataFrame, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Written pairs that have the similarity, by the whole sets of the texts that are in one."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _made(rows, keys.join(used, "node", "left_semi"), "s", "array<long>")
    a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    enough = both * (100 + PERCENT) >= (F.size("sa") + F.size("sb")) * PERCENT
    good = cut_lineage(pairs.join(a, "a").join(b, "b").where(enough).select("a", "b"))
    release(sets)
    return good


def _made(docs: DataFrame, keys: DataFrame, what: str, kind: str) -> DataFrame:
    """``node`` and the whole shingle sets ``s`` or the points ``counts`` of the documents of some keys, one per node."""

    def work(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column("text"))
        nodes = pa.array([_digest(found) for found in sets], pa.int64())
        if what == "s":
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([NONE, *sets])))
        else:
            counts = [np.bincount(found & (GROUPS - 1), minlength=GROUPS) for found in sets]
            made = pa.array([c.astype("u1" if c.max() < 256 else "<u4").tobytes() for c in counts], pa.binary())
        yield record(["node", what], [nodes, made])

    chosen = docs.join(keys.select("key"), "key", "left_semi").select("text")
    return cut_lineage(map_batches(chosen, work, f"node long, {what} {kind}").dropDuplicates(["node"]))


def _cells(spans: DataFrame, points: DataFrame, known: DataFrame) -> DataFrame:
    """Tiles of the members of the branches that hold several classes, sorted by tile."""
    member = spans.where("members > 2").join(known.select("node", "root"), "node", "left")
    member = member.select("token", "node", "n", "rest", "members", F.coalesce("root", "node").alias("root"))
    mixed = (
        member.groupBy("token")
        .agg(
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.count("*").alias("count"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
            F.sum("rest").alias("rest"),
        )
        .where("low <> high")
        .groupBy("count", "x", "y")
        .agg(F.max_by("token", "rest").alias("token"))  # the one that comes first in all of them
        .select("token")
    )
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    spread = (
        member.join(mixed, "token")
        .join(points.select("node", "counts"), "node")
        .withColumn("t", F.pmod(F.xxhash64("node"), tiles).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    )
    of_cell = ["node", "n", "rest", "counts", "root"]
    left = spread.where("t <= o").select("token", F.col("t").alias("i"), F.col("o").alias("j"), F.lit(False).alias("right"), *of_cell)
    right = spread.where("o < t").select("token", F.col("o").alias("i"), F.col("t").alias("j"), F.lit(True).alias("right"), *of_cell)
    return left.union(right).repartition(*_CELL).sortWithinPartitions(*_CELL)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, n, component`` for every document: the size of its set and the smallest id reachable by links."""
    rows = keyed(docs, id_col, text_col)
    everything = _sizes(rows)
    per_doc = everything.where("bucket is null").drop("bucket")
    frequent = (
        everything.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "bucket").limit(FREQUENT).orderBy("bucket").toPandas()
    )
    filled = per_doc.where("n > 0")
    branches = cut_lineage(_branches(rows, frequent["bucket"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)))
    again = branches.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token")
    again = cut_lineage(again)  # most shingles are in one set; a filter spares them the exchange
    shared = cut_lineage(may_have(branches, "token", again).join(again, "token", "left_semi").distinct())
    release(branches, again)
    heads = shared.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct("n", "node", "rest")).alias("head"))
    spans = shared.join(heads, "token")
    offered = spans.where("node <> head.node").where(
        F.least("rest", "head.rest") * (100 + PERCENT) >= (F.col("n") + F.col("head.n")) * PERCENT
    ).select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
    offered = cut_lineage(offered.distinct())
    involved = spans.where("members > 2").select("node").union(offered.select("a")).union(offered.select("b")).distinct()
    keys = filled.groupBy("node").agg(F.min("key").alias("key"))
    points = _made(rows, keys.join(involved, "node", "left_semi"), "counts", "binary")
    first = _verify(cut_lineage(_bound(offered, points)), rows, keys)
    links = first
    for look in (_nearest_pairs, _tree_pairs):
        cells = _cells(spans, points, components(links))
        pairs = cut_lineage(cells.mapInArrow(look, "a long, b long").distinct())
        links = links.union(_verify(pairs, rows, keys))
        release(pairs)
    release(shared, offered, points)
    root = components(links)
    of_node = filled.select("node", "id").join(root, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    component = of_node.groupBy("root").agg(F.min("id").alias("component"))
    named = of_node.select("node", "root").distinct().join(component, "root").select("node", "component")
    return per_doc.join(named, "node", "left").select(
        "id", "key", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component")
    )
