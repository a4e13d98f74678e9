"""Operator 13, nearest neighbours by vantage-point trees over shards.

Vectors are dealt by a hash over shards of bounded size, so that equal vectors
spread; within a shard equal vectors are one point with its smallest ids (more
can never be among the k nearest).  Every shard gets one tree: a node's vantage
point parts its points at the median of their distances, down to leaves of LEAF
points, and each child keeps the range of its distances.

By the triangle inequality, a child whose range lies between ``low`` and
``high`` holds no point nearer than ``low - d`` or ``d - high``, d being the
query's distance to the vantage point; a leaf's bound is the greatest on its
way.  Leaves are visited by rising bound, 1, 2, 4, … at a time, and a query stops
at those whose bound times ``factor`` exceeds its k-th distance.  ``factor`` one
is the exact search; a greater one prunes sooner and may miss neighbours.

A task holds one shard and one block of queries at a time.  About the square
root of the shards is searched first; the k-th distance found there then bounds
what all others return, so that a query's rows stay few however many shards
there are.

Results in edge cases: vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do rows without an id; only vectors of
equal length are compared; rows that repeat an id or a vector all count, and
one row equal to the query is its own; with fewer than k candidates all come;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, shuffle_width, written

LEAF = 64
#: Bytes of a shard's vectors as stored, and queries that a task searches at once.
SHARD_BYTES, BLOCK = 16 << 20, 1024
#: Trees prune by what the triangle inequality proves.
EXACT = 1.0
_ULP = 1e-15


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def true_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the components added in their order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


class VantageTree:
    """A balanced tree over distinct points, as arrays per level; ``ids`` has up to ``most`` smallest ids of every point."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, most: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        fresh = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(axis=1)))
        first = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        keep = np.arange(len(ids)) - first[group] < most
        self.points, self.ids, self.owner = vectors[first], ids[keep], group[keep]
        self.begin = np.searchsorted(self.owner, np.arange(len(first) + 1))
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        #: per level: vantage points, and per child the least and greatest distance of its points
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        leaves = [np.arange(len(first))]
        while max(map(len, leaves)) > LEAF:
            vantage, lows, highs, below = [], [], [], []
            for members in leaves:
                here = self.points[members]
                v = members[np.argmax(np.linalg.norm(here - here.mean(axis=0), axis=1))]
                d = np.linalg.norm(here - self.points[v], axis=1)
                half = len(members) // 2
                parted = np.argpartition(d, half)
                for side in (parted[:half], parted[half:]):
                    below.append(members[side])
                    lows.append(d[side].min() if len(side) else np.inf)
                    highs.append(d[side].max() if len(side) else -np.inf)
                vantage.append(v)
            self.levels.append((np.array(vantage), np.array(lows), np.array(highs)))
            leaves = below
        self.leaves = leaves

    def _distances(self, queries: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances by one product of matrices, and a bound of their error."""
        with np.errstate(all="ignore"):
            size = np.einsum("ij,ij->i", queries, queries)[:, None] + self.squares[at]
            return size - 2 * (queries @ self.points[at].T), _ULP * (queries.shape[1] + 4) * size

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For every query and leaf, a distance below which the leaf has no point."""
        least = np.zeros((len(queries), 1))
        for vantage, lows, highs in self.levels:
            square, error = self._distances(queries, vantage)
            with np.errstate(all="ignore"):
                d, slack = np.sqrt(np.maximum(square, 0)), np.sqrt(error)
                d, slack = (np.repeat(x, 2, axis=1) for x in (d, slack))
                own = np.maximum(lows - d, d - highs) - slack
            least = np.maximum(np.repeat(least, 2, axis=1), np.where(np.isnan(own), 0, own))
        return least

    def search(self, queries: np.ndarray, k: int, within: np.ndarray, factor: float = EXACT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query number, id, distance) of the nearest ``k`` rows per query not beyond ``within``, and how many distances were computed."""
        found = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        least, limit, seen = self.bounds(queries), within.copy(), 0
        order = np.argsort(least, axis=1, kind="stable")
        done = 0
        while done < len(self.leaves):
            turn = order[:, done : 2 * done + 1]
            q, where = np.nonzero(np.take_along_axis(least, turn, axis=1) * factor <= limit[:, None])
            if not len(q):
                break
            leaf = turn[q, where]
            by_leaf = np.argsort(leaf, kind="stable")
            q, leaf = q[by_leaf], leaf[by_leaf]
            pairs = []
            for group in np.split(np.arange(len(q)), np.flatnonzero(np.diff(leaf)) + 1):
                members, asking = self.leaves[leaf[group[0]]], q[group]
                square, error = self._distances(queries[asking], members)
                seen += square.size
                with np.errstate(all="ignore"):
                    a, b = np.nonzero(~(square > limit[asking][:, None] ** 2 + error))
                pairs.append((asking[a], members[b]))
            asked, point = (np.concatenate(x) for x in zip(*pairs))
            d = true_distances(queries[asked], self.points[point])
            near = d <= limit[asked]
            asked, point, d = asked[near], point[near], d[near]
            # every row of a point is a candidate
            n = self.begin[point + 1] - self.begin[point]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[point], n)
            found = tuple(np.concatenate(x) for x in zip(found, (np.repeat(asked, n), self.ids[place], np.repeat(d, n))))
            best = np.lexsort((found[1], found[2], found[0]))
            found = tuple(x[best] for x in found)
            rank = np.arange(len(best)) - np.searchsorted(found[0], found[0])
            last = rank == k - 1
            limit[found[0][last]] = np.minimum(limit[found[0][last]], found[2][last])
            found = tuple(x[rank < k] for x in found)
            done = 2 * done + 1
        return *found, seen


def _stacked(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for every length of vector."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat, begins = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths) - lengths
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield rows, flat[begins[rows][:, None] + np.arange(length)]


def _searched(k: int, factor: float):
    """Streams (shard, asks, key, vector, within): each shard's vectors first, then the queries that it is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, trees = None, {}, None
        for batch in batches:
            shards, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, parts, trees = shards[a], {}, None
                if not asks[a]:
                    piece = batch.slice(a, b - a)
                    keys = piece.column("key").to_numpy()
                    for rows, matrix in _stacked(piece.column("vector")):
                        parts.setdefault(matrix.shape[1], []).append((matrix, keys[rows]))
                    continue
                if trees is None:
                    trees = {size: VantageTree(*(np.concatenate(x) for x in zip(*p)), k) for size, p in parts.items()}
                    parts = {}
                for start in range(a, b, BLOCK):
                    piece = batch.slice(start, min(BLOCK, b - start))
                    keys, within = piece.column("key").to_numpy(), piece.column("within").to_numpy()
                    for rows, matrix in _stacked(piece.column("vector")):
                        if matrix.shape[1] in trees:
                            q, ids, d, _ = trees[matrix.shape[1]].search(matrix, k, within[rows], factor)
                            yield pa.RecordBatch.from_arrays([pa.array(keys[rows][q]), pa.array(ids), pa.array(d)], names=["key", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = EXACT, shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` nearest to every row of ``queries``, both (vec_id, embedding).

    A query that is itself a row of ``vectors`` does not find itself.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    points = clean(vectors)
    if shards is None:
        size = vectors.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0] * (8 if "double" in dict(vectors.dtypes)["embedding"] else 4)
        shards = max(shuffle_width(spark), -(-size // SHARD_BYTES))
    with Scratch(spark) as scratch:
        asked = scratch.written(clean(queries).withColumn("key", F.monotonically_increasing_id()), "queries")
        dealt = points.select(F.pmod(F.xxhash64("vec_id", "embedding", F.rand(13)), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.lit(0.0).alias("within"))
        dealt = scratch.written(dealt, "shards")
        newest = Window.partitionBy("key").orderBy("score", "vec_id")
        best = lambda rows: rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k + 1)

        def turn(low: int, high: int, within: DataFrame, name: str) -> DataFrame:
            every = within.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).select("shard", F.lit(True).alias("asks"), "key", F.col("embedding").alias("vector"), "within")
            rows = dealt.where(F.col("shard").between(low, high - 1)).unionByName(every)
            placed = rows.repartition(high - low, "shard").sortWithinPartitions("shard", "asks")
            return scratch.written(placed.mapInArrow(_searched(k + 1, factor), "key long, vec_id long, score double"), name)

        first = min(shards, math.isqrt(shards) + 1)
        early = turn(0, first, asked.withColumn("within", F.lit(float("inf"))), "near")
        found = early
        if first < shards:
            reach = best(early).where(F.col("rank") == k + 1).select("key", F.col("score").alias("reach"))
            bounded = asked.join(reach, "key", "left").withColumn("within", F.coalesce("reach", F.lit(float("inf"))))
            found = early.unionByName(turn(first, shards, bounded, "nearer"))
        ranked = best(found).join(asked.select("key", F.col("vec_id").alias("query_id")), "key")
        own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
        itself = F.min(F.when(own, F.col("rank"))).over(Window.partitionBy("key"))
        kept = ranked.withColumn("own", F.coalesce(itself, F.lit(k + 1))).where(F.col("rank") != F.col("own"))
        rank = F.when(F.col("rank") < F.col("own"), F.col("rank")).otherwise(F.col("rank") - 1)
        return written(kept.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score"), "neighbours")
