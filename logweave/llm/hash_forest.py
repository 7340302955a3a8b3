"""Approximate nearest neighbours (operator 5): a hash-prefix forest.

Each tree gives every vector a long string of bits (signs of projections on random directions). A shard of rows keeps, for
each tree, its strings sorted. A query descends to the longest prefix it shares with strings of the trees; then all
trees ascend together, one bit at a time, until the ranges that match hold enough distinct rows other than its own: the
share ENOUGH of the shard, LEAST rows at least, and all rows where there are no more. Candidates are ranked by the exact
inner product in double precision.

Inner products become angles by one more coordinate, sqrt(M^2 - |x|^2), M the largest norm. Rows and queries are dealt
to shards and blocks of bounded size by a hash, and every shard meets every block, so no query's candidates are capped by
where a row lies, and results of shards are merged by rank.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different lengths never
meet. Rows that repeat a vec_id count once (the least vector); rows without vec_id take no part. Of equal vectors only the
k + 1 least vec_ids can be among the k nearest of a query, so no others are indexed, and copies shadow nothing. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import staged, table

TREES, BITS, ENOUGH, LEAST = 320, 32, 0.24, 800
SHARD_ROWS, BLOCK_QUERIES = 8192, 8192


def directions(dim: int, trees: int = TREES, seed: int = 55) -> np.ndarray:
    """Random directions of every tree and bit, for vectors of dim coordinates and the added one."""
    return np.random.default_rng(seed).standard_normal((dim + 1, trees * BITS)).astype(np.float32)


def strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(tree, row) bit strings as numbers, the first bit on top."""
    trees = planes.shape[1] // BITS
    out = np.empty((trees, len(x)), np.uint32)
    weight = np.uint32(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint32)
    x = x.astype(np.float32)
    for t in range(trees):
        signs = (x @ planes[:, t * BITS : (t + 1) * BITS]) > 0
        out[t] = (signs * weight).sum(axis=1, dtype=np.uint32)
    return out


class Forest:
    """Sorted bit strings of the rows of one shard."""

    def __init__(self, x: np.ndarray, largest: float, planes: np.ndarray):
        rest = np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))
        self.x, self.planes = x, planes
        h = strings(np.column_stack([x, rest]), planes)
        self.order = np.argsort(h, axis=1, kind="stable")
        self.keys = np.take_along_axis(h, self.order, axis=1)

    def ranges(self, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in every tree of the strings that share `length` leading bits with each query's: (tree, query)."""
        drop = (BITS - length).astype(np.uint64)
        low = (h.astype(np.uint64) >> drop) << drop
        high = low + (np.uint64(1) << drop)
        lo = np.stack([np.searchsorted(k, a, "left") for k, a in zip(self.keys.astype(np.uint64), low, strict=True)])
        hi = np.stack([np.searchsorted(k, b, "left") for k, b in zip(self.keys.astype(np.uint64), high, strict=True)])
        return lo, hi

    def candidates(self, queries: np.ndarray, own: np.ndarray, wanted: int) -> list[np.ndarray]:
        """For each query the rows of its ranges at the depth where all trees together hold `wanted` distinct rows, its own
        (a position, or -1) not counted and left out; all others if there are fewer."""
        h = strings(np.column_stack([queries, np.zeros(len(queries))]), self.planes)
        # ranges with repeats hold no fewer rows than distinct ones: the ascent begins where those are enough
        short, long = np.zeros(len(queries), np.int64), np.full(len(queries), BITS + 1)
        while (long - short > 1).any():
            mid = (short + long) // 2
            lo, hi = self.ranges(h, mid)
            good = (hi - lo).sum(axis=0) >= wanted
            short, long = np.where(good, mid, short), np.where(good, long, np.maximum(mid, short + 1))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        todo, n = np.arange(len(queries)), len(self.x)
        places, tree = self.order.ravel(), np.arange(len(self.order))[:, None] * n
        while len(todo):
            lo, hi = self.ranges(h[:, todo], short[todo])
            again = []
            for j, q in enumerate(todo.tolist()):
                many = hi[:, j] - lo[:, j]
                stops = np.cumsum(many)
                mask = np.zeros(n, bool)
                mask[places[np.repeat(tree[:, 0] + lo[:, j] - (stops - many), many) + np.arange(stops[-1])]] = True
                if own[q] >= 0:
                    mask[own[q]] = False
                if np.count_nonzero(mask) >= wanted or short[q] == 0:
                    out[q] = np.flatnonzero(mask)
                else:
                    again.append(q)
            todo = np.array(again, np.int64)
            short[todo] -= 1
        return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", enough: float = ENOUGH, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query, its own key left out."""

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(column).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

    copy = F.row_number().over(W.partitionBy("v").orderBy("id"))
    rows, asked = staged(clean(vectors).withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "vectors"), staged(clean(queries), "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, largest, m = *rows.agg(F.count("*"), F.max(norm)).first(), asked.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_QUERIES))
    largest = float(largest or 0.0)
    left = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), "id", "v")
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "v")

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, x = mine.column("id").to_numpy(), matrix(mine)
        who, q = theirs.column("id").to_numpy(), matrix(theirs)
        found: list[tuple] = []
        if len(ids) and len(who):
            forest = Forest(x, largest, directions(x.shape[1]))
            by_id = np.argsort(ids, kind="stable")
            at = np.minimum(np.searchsorted(ids[by_id], who), len(ids) - 1)
            own = np.where(ids[by_id][at] == who, by_id[at], -1)
            wanted = max(k, least, int(enough * len(ids)))
            for at in range(0, len(who), 256):
                for j, rows_ in enumerate(forest.candidates(q[at : at + 256], own[at : at + 256], wanted), at):
                    score = np.einsum("ij,j->i", x[rows_], q[j])
                    best = np.lexsort((ids[rows_], -score))[:k]
                    found.append((np.full(len(best), who[j]), ids[rows_][best], score[best]))
        a, b, c = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    by = ["dim", "shard", "block"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
