"""Document fingerprints (operator 10): MinHash by universal hash permutations over word shingles.

A permutation is x -> a*x + b modulo 2**64 with odd a, and a lane keeps the top bits of the least value, so the share of
equal lanes estimates the Jaccard similarity of the shingle sets. Near duplicates are found by joining bands of
the lanes and verifying each pair on the shingles themselves (`near_duplicates`, for all pairs of a corpus). Of a
document and its edited text, and the next document, the same is told pair by pair: the bands that agree, and the exact
Jaccard similarity where one does.

Null texts count as empty; a text without words has the all-ones fingerprint, so equal texts have equal ones. Rows that
repeat a doc_id follow each other by text; rows without doc_id come last. One row alone is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import mix, packed, seeds, shingles, slices, table, tidy
from ._links import classes, regions

LANES = 128
#: Bands and lanes of each, for joining near duplicates.
BANDS, ROWS = 45, 7
#: Bands of a fingerprint of LANES lanes: of 6 lanes each, two texts of a likeness of 0.8 agree in one with 0.998.
PAIR_BANDS = 21
_A, _B = seeds(BANDS * ROWS, 11) | np.uint64(1), seeds(BANDS * ROWS, 12)
#: Documents in a run of neighbours that one task handles, and the most runs.
RUN, RUNS = 2000, 20_000


def signatures(h: np.ndarray, counts: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The least value of each permutation for rows of shingle hashes; all ones for rows without."""
    out = np.full((len(counts), lanes), np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = 0
        ends = np.cumsum(counts[some])
        while at < len(some):
            begin = ends[at] - counts[some[at]]
            to = max(at + 1, int(np.searchsorted(ends, begin + 30_000, side="right")))
            part, starts = h[begin : ends[to - 1]], ends[at:to] - counts[some[at:to]] - begin
            value = np.empty_like(part)
            for j in range(lanes):
                np.multiply(part, _A[j], out=value)
                np.add(value, _B[j], out=value)
                out[some[at:to], j] = np.minimum.reduceat(value, starts)
            at = to
    return out


def prints(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The fingerprint of each text, LANES numbers of 16 bits, and its sorted shingle set."""
    data, offsets = packed(pa.array(texts, pa.large_string()))
    out, sets = np.empty((len(texts), LANES), np.uint16), []
    for a, b in slices(offsets, 1 << 19):
        h, counts = regions(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), weighted=False)
        out[a:b] = (signatures(h, counts) >> np.uint64(48)).astype(np.uint16)
        sets += np.split(h, np.cumsum(counts)[:-1])
    return out, sets


def agreeing_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of PAIR_BANDS bands the fingerprints of each row agree."""
    size = LANES // PAIR_BANDS
    return (a == b)[:, : PAIR_BANDS * size].reshape(len(a), PAIR_BANDS, size).all(axis=2).sum(axis=1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact, of sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / ((len(a) + len(b) - both) or 1) if len(a) or len(b) else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last half of code points replaced by as many from the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(key, class_id) by bands of lanes, verified on the shingle sets: the general form of this operator."""

    def signer(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        lanes = signatures(h, counts, BANDS * ROWS).reshape(len(counts), BANDS, ROWS)
        band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), lanes.shape[:2]).copy()
        for i in range(ROWS):
            band = mix(band ^ lanes[:, :, i]) * np.uint64(0xD1342543DE82EF95)
        return mix(band)

    return classes(docs, signer, key, text, threshold=threshold, weighted=False, label="minhash")


def in_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (run, tail, id, key, text), each partition sorted: runs of neighbours by descending key, and after each run as
    its tail the first document of the next. One shuffle of the texts; the driver gets the bounds of the runs only."""
    least = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    ids = docs.select(least.alias("id"))
    n = ids.count()
    # a run is a stream, so its length is no matter of memory; the driver gets a row for each run, RUNS at most
    parts = min(RUNS, max(1, -(-n // RUN)))
    dealt = ids.repartitionByRange(parts, F.col("id")) if parts > 1 else ids.coalesce(1)
    found = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    highs = np.sort(np.array([r["hi"] for r in found], np.int64))
    rows = docs.select(least.alias("id"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(highs) - 1
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(highs, ids)
            run = last - part
            first = np.flatnonzero(ids == highs[np.minimum(part, last)])
            pick = np.concatenate([np.arange(len(ids)), first])
            taken = batch.take(pa.array(pick))
            to = np.concatenate([run, np.where(run[first] == 0, last, run[first] - 1)])
            tail = np.concatenate([np.zeros(len(ids), bool), np.ones(len(first), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), pa.array(tail), *taken.columns], ["run", "tail", "id", "key", "text"])

    return rows.mapInArrow(tidy(deal), f"run long, tail boolean, id long, key {kind}, text string").repartition(max(2, parts), "run").sortWithinPartitions("run", "tail", F.desc("id"), "text")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness, also to the next document's; for both
    pairs the number of bands that agree and, if any does, the exact Jaccard similarity (else null)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int, jaccard_edited double, jaccard_next double"

    def report(keys: list, texts: list[str]) -> pa.RecordBatch:
        """Of texts that follow each other; the last is only the next of the one before."""
        made = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        (own, sets), (new, made_sets) = prints(texts), prints(made)
        bands = [agreeing_bands(own[:-1], new), agreeing_bands(own[:-1], own[1:])]
        exact = [[jaccard(a, b) if k else None for a, b, k in zip(sets, other, some.tolist(), strict=False)] for other, some in ((made_sets, bands[0]), (sets[1:], bands[1]))]
        hexes = lambda p: pa.array([x.astype(">u2").tobytes().hex() for x in p], pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64() if kind == "bigint" else None),
                pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in made], pa.string()),
                hexes(own[:-1]),
                hexes(new),
                pa.array((own[:-1] == new).mean(axis=1)),
                pa.array((own[:-1] == own[1:]).mean(axis=1)),
                *[pa.array(x.astype(np.int32)) for x in bands],
                *[pa.array(x, pa.float64()) for x in exact],
            ],
            [x.split(" ")[0] for x in schema.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list[str] = []
        size, at, closed = 0, None, False
        for batch in batches:
            runs, tails = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r, tail, k, value in zip(runs, tails, batch.column(3), batch.column(4), strict=True):
                if r != at:
                    keys, texts, size, at, closed = [], [], 0, r, False
                if closed:
                    continue
                one = value.as_py()
                texts.append(one)
                size += len(one)
                if tail or size > 1 << 20:
                    if len(texts) > 1:
                        yield report(keys, texts)
                    closed = tail
                    keys, texts, size = [], texts[-1:], len(one)
                if not tail:
                    keys.append(k.as_py())

    return in_runs(docs, key, text).mapInArrow(tidy(run), schema)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
