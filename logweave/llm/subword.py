"""Quality classifier (operator 1): supervised subword embeddings.

A document is the average of learned vectors of its hashed words and of the character n-grams of those words; a softmax
layer gives the class. Vectors and layer are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows (SAMPLE rows, the least hashes of doc_id among the training rows, as far as SAMPLE_BYTES of text). To score, the layer is folded into the
vectors, so each feature is one number and each whole text one pass over its bytes.

Null and empty texts have no features and get the score of the bias alone. Rows that repeat a doc_id are scored each;
labels that contradict each other count as their larger value. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _GAP, packed, remainder, seeds, slices, span_hashes, table, tidy, training_rows, word_bounds

SAMPLE = 3000
BITS, DIM, EPOCHS, RATE = 17, 8, 8, 0.4
GRAMS = (3, 4)
#: The number of the feature `the same word as before`, a word token of its own.
ECHO = 1
_CODE = (seeds(256, 5) >> np.uint64(32)).astype(np.uint32)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature numbers of rows of bytes, in several groups; with each group the bounds of the rows in it.

    Group 1: whole words. Group 2: one token for each word that repeats the one before. Further groups: n-grams that lie in a word with one blank at either side."""
    n_rows = len(offsets) - 1
    starts, ends, counts = word_bounds(data, offsets)
    full = span_hashes(data, starts, ends, fold=False)
    word = (full >> np.uint64(64 - BITS)).astype(np.int64)
    by_row = np.concatenate([[0], np.cumsum(counts)])
    again = np.zeros(len(full), bool)
    folded = span_hashes(data, starts, ends)
    again[1:] = folded[1:] == folded[:-1]
    again[by_row[:-1][by_row[:-1] < len(full)]] = False
    echo = np.flatnonzero(again)
    ids, bounds = [word, np.full(len(echo), ECHO)], [by_row, np.searchsorted(echo, by_row)]
    # a blank before and after each row, so that no n-gram crosses rows
    wide = np.full(len(data) + n_rows + 1, 32, np.uint8)
    wide[np.arange(len(data)) + np.repeat(np.arange(1, n_rows + 1), np.diff(offsets))] = data
    edge = offsets + np.arange(n_rows + 1)
    gap = _GAP[wide]
    code = _CODE[np.where(gap, 32, wide)]
    h = code.copy()
    solid = np.ones(len(wide), bool)  # no blank inside, from the second to the last but one
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
        if n >= 3:
            solid = solid[: len(h)] & ~gap[n - 2 : n - 2 + len(h)]
        else:
            solid = solid[: len(h)]
        if n in GRAMS:
            at = np.flatnonzero(solid)
            mixed = h[at] * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            ids.append(((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int64))
            bounds.append(np.searchsorted(at, edge))
    return ids, bounds


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Subword:
    """A trained model, folded: one number for each feature, and the bias."""

    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, bounds = features(data, offsets)
        total = sum(row_sums(self.weight[i], b) for i, b in zip(ids, bounds, strict=True))
        count = sum(np.diff(b) for b in bounds)
        return 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Subword:
    """rows: feature numbers, their shares in the document, and the label."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, share, label = rows[k]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            logit = layer @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            if len(ids):
                # a document's features share its step by their weight; DIM-wide rows are updated in place
                vectors[ids] -= (rate * 10 * share[:, None]) * (p @ layer)[None, :]
            layer -= rate * np.outer(p, mean)
            bias -= rate * np.float32(0.1) * p
    return Subword((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out: F.Column, most: int = SAMPLE) -> Subword:
    """Train on at most `most` labelled rows whose texts are in docs."""
    rows = training_rows(docs, labels, label, held_out, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                ids, _ = features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                some, many = np.unique(np.concatenate(ids), return_counts=True)
                out.append((some.astype(np.int32).tobytes(), (many / max(1, many.sum())).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["doc_id", "y", "ids", "share"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(tidy(run), f"doc_id {kind}, y int, ids binary, share binary").collect()
    seen = {(r["doc_id"], bytes(r["ids"])): r for r in sorted(found, key=lambda r: (r["doc_id"], bytes(r["ids"])))}
    data = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["share"], np.float32), r["y"]) for r in seen.values()]
    return train(data)


def score(docs: DataFrame, model: Subword, held_out: F.Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(2))
            out = np.empty(batch.num_rows)
            for a, b in slices(offsets, 1 << 19):
                out[a:b] = model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(5) == 0
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), "quality", held), held)
