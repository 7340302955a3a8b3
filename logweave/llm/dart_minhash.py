"""MinHash near-dedup (operator 2): DartMinHash signatures of weighted shingle sets, joined by bands.

Each unit of an element's weight is a region; darts fall on it as a Poisson process along the rank axis, its gaps drawn
from hashes of (element, unit, number), so equal regions have equal darts in every document. Darts up to a rank are
hashed to K coordinates and the earliest of each coordinate is kept. The rank is about K*(ln K + 2) over the total
weight, and doubles for the few documents whose coordinates are not all hit, so long documents throw no more darts than
short ones. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Weights are whole numbers here: the count of a word 5-gram in its document (a document of fewer words is one shingle), so
a region is a pair of shingle and occurrence number, and weighted Jaccard similarity is that of the sets of regions.
Null and empty documents get no signature and stay classes of their own; ties go to the smaller doc_id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import mix, staged, table
from ._links import classes, without

#: 45 bands of 7 coordinates miss a pair of similarity 0.8 once in 40,000 times and one of 0.85 once in 10 million.
BANDS, ROWS = 45, 7


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(row: np.ndarray, region: np.ndarray, limit: np.ndarray, k: int, out: np.ndarray) -> None:
    """Throw the darts of every region up to its row's limit; out[row, coordinate] keeps the least rank."""
    rank, number = np.zeros(len(row)), 0
    flat = out.reshape(-1)
    while len(row):
        number += 1
        draw = mix(region + np.uint64(number * 0x9E3779B97F4A7C15 % 2**64))
        rank = rank - np.log(_unit(draw))
        live = rank <= limit[row]
        row, region, rank, draw = row[live], region[live], rank[live], draw[live]
        np.minimum.at(flat, row * k + (mix(draw) % np.uint64(k)).astype(np.int64), rank)


def signatures(region: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Ranks of the earliest dart in each of k coordinates for rows of regions; every row has one or more."""
    out = np.full((len(counts), k), np.inf)
    row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    limit = k * (math.log(k) + 2) / counts
    todo = np.arange(len(counts))
    while len(todo):
        pick = np.isin(row, todo) if len(todo) < len(counts) else slice(None)
        darts(row[pick], region[pick], limit, k, out)
        todo = np.flatnonzero(np.isinf(out).any(axis=1))
        limit[todo] *= 2
    return out


def band_keys(ranks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    bits = np.ascontiguousarray(ranks).view(np.uint64).reshape(len(ranks), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(ranks), bands)).copy()
    for i in range(rows):
        key = mix(key ^ bits[:, :, i]) * np.uint64(0xD1342543DE82EF95)
    return mix(key)


def signer(region: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return band_keys(signatures(region, counts, BANDS * ROWS), BANDS, ROWS)


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(key, class_id): documents linked by a similarity of the threshold or more have one class id, its least key."""
    return classes(docs, signer, key, text, threshold=threshold, label="dart")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the smallest id of each class; rows without an id stay. Rows that repeat an id are rows of
    their own, compared by their texts like any others."""
    named = docs.where(F.col(key).isNotNull())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if named.groupBy(key).count().where("count > 1").limit(1).count():
        # numbered in a written table, so that every pass sees the same numbers
        rows = staged(named.dropDuplicates([key, text]).select(row, F.monotonically_increasing_id().alias("k")), "keyed")
        found = rows.select("k", F.col(f"row.`{key}`").alias("id")).join(near_classes(rows, "k", f"row.`{text}`"), "k")
        kept = found.groupBy("class_id").agg(F.min(F.struct("id", "k"))["k"].alias("k")).select("k")
        rows = rows.join(kept, "k", "left_semi")
    else:
        gone = near_classes(docs, key, text).where(F.col(key) != F.col("class_id")).select(F.col(key).alias("id"))
        rows = without(named.select(row, F.col(key).cast("long").alias("id")), staged(gone, "dart-gone"))
    return rows.select("row.*").unionByName(docs.where(F.col(key).isNull()))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
