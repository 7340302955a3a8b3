"""Helpers shared by the operators: tables, the shared folder, and packed text batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the cluster names none, a temporary one is set, on local masters
    only (tests); a cluster without one is an error, since its machines would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="logweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/logweave/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._logweave_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove a table made by staged() that nothing reads any more."""
    path = getattr(df, "_logweave_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """run, whose worker gives its free memory back to the system after each partition: Spark keeps idle workers for later
    stages, and what they hold counts against the executor."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return wrapped


#: The most bytes of text in a sample of labelled rows.
SAMPLE_BYTES = 64 << 20


def remainder(mod: int) -> Column:
    """crc32 of doc_id as text modulo a number: the fold of a row; a missing doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows and about `most_bytes` of text, the same at every run, as a written
    table. Labels of one doc_id that contradict each other count as their larger value."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    one = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    turn = F.xxhash64("doc_id")
    chosen = F.broadcast(one.orderBy(turn, "doc_id").limit(most))  # at most `most` pairs of numbers
    rows = staged(docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "y"), "labelled")
    sizes = rows.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("n"))
    before = F.sum("n").over(W.orderBy(turn, "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    fit = F.broadcast(sizes.withColumn("before", before).where(F.col("before") < most_bytes).select("doc_id"))  # as few
    return rows.join(fit, "doc_id", "left_semi")


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, a longer row alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, the rest spread evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = seeds(256, 77)
_FOLDED = _BYTE[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[key] = have = np.multiply.accumulate(have)
    return have[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than ASCII white space) and the count of words of each row."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, np.int64)
    inside = ~_GAP[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


class SpanHasher:
    """64-bit hashes of spans of bytes from one running sum; ASCII letters alike in either case if fold."""

    def __init__(self, data: np.ndarray, fold: bool = True):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[data] * _power(_BASE, n), out=self.total[1:])
        self.inverse = _power(_BASE_INV, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts] + length)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    return SpanHasher(data, fold)(starts, ends)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `words` words of each row, in order, and the count of each row.

    A row of fewer words has one shingle of all of them; a row without words has none. Case of ASCII letters and the
    kind and amount of white space do not matter."""
    starts, ends, counts = word_bounds(data, offsets)
    h = span_hashes(data, starts, ends)
    n = len(h)
    many = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    if n == 0:
        return np.zeros(0, np.uint64), many
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    firsts = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(len(counts)), many)
    step = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
    at = firsts[:-1][rows] + step
    acc = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = k < counts[rows]
        acc = acc * np.uint64(0xD1342543DE82EF95) + np.where(inside, padded[at + k] + np.uint64(k + 1), np.uint64(0))
    return mix(acc), many
