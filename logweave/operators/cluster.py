"""Leader-style clustering of normalised rows, and how many samples a cluster keeps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions import text as T

_MARK = re.compile(T.PLACEHOLDER)


def _agree(tokens: list[str], template: list[str]) -> float:
    pairs = [(a, b) for a, b in zip(tokens, template, strict=True) if b != T.WILD]
    if not pairs:
        return 1.0
    return sum(a == b or bool(_MARK.match(a)) or bool(_MARK.match(b)) for a, b in pairs) / len(pairs)


def _fold(rows: list[tuple], threshold: float, most: int) -> list[int]:
    """For rows in order the number of their cluster in the bucket; a template takes <*> where its members differ."""
    templates: list[list[str]] = []
    out = []
    for tokens in rows:
        best, score = -1, -1.0
        for k, template in enumerate(templates) if len(templates) <= most else ():
            s = _agree(tokens, template)
            if s > score:
                best, score = k, s
                if s == 1.0:
                    break
        if best >= 0 and score >= threshold:
            t = templates[best]
            for i, token in enumerate(tokens):
                if t[i] != token and not (_MARK.match(t[i]) and _MARK.match(token)):
                    t[i] = T.WILD
        else:
            best = len(templates)
            templates.append(list(tokens))
        out.append((best, templates))
    return out


def cluster(rows: DataFrame, threshold: float = 0.82, most: int = 5000) -> DataFrame:
    """rows of normalized() with cluster_id, sizes, weight and template guess.

    Buckets (token count, first two and last stable tokens) never meet, so each is folded on its own in the order of
    first places; cluster numbers follow the first place of each cluster. The fold of one bucket is sequential by
    definition; its state is at most the bucket's templates."""
    toks = rows.withColumn("_t", T.tokens(F.col("normalized_content"))).withColumn("_b", T.bucket_key(F.col("_t")))
    slim = toks.select("dataset", "_b", "ord", "_t")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        marks = _fold([list(t) for t in pdf["_t"]], threshold, most)
        finals = marks[-1][1] if marks else []
        return pd.DataFrame({"dataset": pdf["dataset"], "ord": pdf["ord"], "_k": [m for m, _ in marks], "_tpl": [finals[m] for m, _ in marks]})

    folded = slim.groupBy("dataset", "_b").applyInPandas(run, "dataset string, ord long, _k int, _tpl array<string>")
    placed = toks.join(folded, ["dataset", "ord"])
    group = ["dataset", "_b", "_k"]
    sizes = placed.groupBy(*group).agg(
        F.min("ord").alias("_first"), F.sum("normalized_unique_content_count").alias("cluster_size_unique"), F.sum("dup_count").alias("cluster_weight_dup_sum"),
        F.count("*").alias("cluster_size_normalized_rows"), F.first("_tpl").alias("_guess"),
        F.max_by(F.struct("content", "normalized_content"), F.struct("dup_count", -F.col("line_id"), -F.col("ord"))).alias("_rep"),
    )
    number = F.row_number().over(W.partitionBy("dataset").orderBy("_first"))
    named = sizes.select(
        *group, F.format_string("%s_C%07d", "dataset", number).alias("cluster_id"), "cluster_size_unique", "cluster_weight_dup_sum", "cluster_size_normalized_rows",
        T.template_guess(F.col("_guess")).alias("cluster_template_guess"), F.col("_rep.content").alias("representative_content"), F.col("_rep.normalized_content").alias("representative_normalized_content"),
    )
    return placed.join(named, group).drop("_b", "_k", "_t", "_tpl")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """One row for each cluster, with the number of samples recommended."""
    keys = ["dataset", "cluster_id", "cluster_size_normalized_rows", "cluster_size_unique", "cluster_weight_dup_sum", "cluster_template_guess", "representative_content", "representative_normalized_content"]
    rows = clustered.select(*keys).distinct()
    return rows.withColumn("recommended_keep_k_balanced", retention(F.col("cluster_weight_dup_sum"), F.col("cluster_size_unique")))


def retention(weight: Column, unique: Column) -> Column:
    """Samples recommended by weight and size, both needed."""
    return F.when((weight >= 100_000) & (unique >= 100), 3).when((weight >= 1_000) & (unique >= 10), 2).otherwise(1)


def keep_k(weight: Column, unique: Column, rows: Column) -> Column:
    """Samples kept: any of weight, size and rows suffices, at most as many as there are rows."""
    k = F.when((unique >= 100) | (weight >= 100_000) | (rows >= 5), 3).when((unique >= 10) | (weight >= 1_000) | (rows >= 2), 2).otherwise(1)
    return F.least(k, rows.cast("int"))


