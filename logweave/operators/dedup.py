"""Exact and normalised deduplication, content-disjoint splits, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import text as T


def exact(logs: DataFrame) -> DataFrame:
    """One row for each dataset and content: the first in order, with dup_count."""
    rest = [c for c in logs.columns if c not in ("dataset", "content")]
    first = F.min_by(F.struct(*rest), "ord").alias("r")
    return logs.groupBy("dataset", "content").agg(first, F.count("*").alias("dup_count")).select("dataset", "content", *[f"r.{c}" for c in rest], "dup_count")


def normalized(rows: DataFrame, mask=T.normalize) -> DataFrame:
    """One row for each dataset and normalised content, from the output of exact().

    The representative has the most duplicates, then the least line number, then the first place; ord becomes the
    group's first place, which later steps use as their order."""
    named = rows.withColumn("normalized_content", mask(F.col("content")))
    rest = [c for c in rows.columns if c not in ("dataset", "dup_count", "ord")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("dup_count"), -F.col("line_id"), -F.col("ord"))).alias("r")
    grouped = named.groupBy("dataset", "normalized_content").agg(best, F.min("ord").alias("ord"), F.sum("dup_count").alias("dup_count"), F.count("*").alias("normalized_unique_content_count"))
    return grouped.select("dataset", *[f"r.{c}" for c in rest], "ord", "dup_count", "normalized_content", "normalized_unique_content_count")


def summary(rows: DataFrame) -> DataFrame:
    """Per dataset: rows kept and the logs they stand for."""
    return rows.groupBy("dataset").agg(F.count("*").alias("unique_count"), F.sum("dup_count").alias("original_log_count"))


def test_split(full: DataFrame, train: DataFrame) -> DataFrame:
    """Rows of full whose content is not in train's of the same dataset; every repeat of a known content goes."""
    seen = train.select("dataset", "content").distinct()
    return full.join(seen, ["dataset", "content"], "left_anti").select(*full.columns)


def split_summary(full: DataFrame, train: DataFrame) -> DataFrame:
    """Per dataset: all rows, distinct training contents, rows removed, rows kept."""
    seen = train.select("dataset", "content").distinct().withColumn("hit", F.lit(1))
    joined = full.join(seen, ["dataset", "content"], "left")
    counts = joined.groupBy("dataset").agg(F.count("*").alias("full_count"), F.count("hit").alias("removed_count"))
    known = seen.groupBy("dataset").agg(F.count("*").alias("unique_train_contents"))
    out = counts.join(known, "dataset", "left")
    return out.select("dataset", "full_count", F.coalesce("unique_train_contents", F.lit(0)).cast("long").alias("unique_train_contents"), "removed_count", (F.col("full_count") - F.col("removed_count")).alias("test_count"))
