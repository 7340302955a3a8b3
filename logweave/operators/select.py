"""Selection of samples from clusters: balanced, random and representative, and what a selection covers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.operators.cluster import keep_k


def _first(order: list) -> F.Column:
    return F.row_number().over(W.partitionBy("dataset", "cluster_id").orderBy(*order))


def balanced(clustered: DataFrame) -> DataFrame:
    """cluster_keep_k rows of each cluster: the most frequent, then the most complex, then the most different one.

    Candidates beyond the first are ranked by window; the chosen rows come back as a narrow join, so no cluster is
    gathered as a whole."""
    n = F.count("*").over(W.partitionBy("dataset", "cluster_id"))
    rows = clustered.withColumn("_n", n)
    rows = rows.withColumns({"cluster_keep_k": keep_k(F.col("cluster_weight_dup_sum"), F.col("cluster_size_unique"), F.col("_n")), "_set": F.array_distinct(T.tokens(F.col("normalized_content"))), "_len": F.length("content")})
    line = F.col("line_id")
    ranked = rows.withColumn("_r1", _first([F.desc("dup_count"), line, "ord"]))
    one = ranked.where("_r1 = 1")
    rest = ranked.where("_r1 > 1 and cluster_keep_k >= 2").withColumn("_r2", _first([F.desc(T.complexity(F.col("content"), F.col("normalized_content"))), F.desc("dup_count"), line, "ord"]))
    two = rest.where("_r2 = 1")
    keys = ["dataset", "cluster_id"]
    a = one.select(*keys, F.col("_set").alias("_s1"), F.col("_len").alias("_l1"))
    b = two.select(*keys, F.col("_set").alias("_s2"), F.col("_len").alias("_l2"))
    last = rest.where("_r2 > 1 and cluster_keep_k >= 3").join(a, keys).join(b, keys)
    far = F.least(T.jaccard_distance(F.col("_set"), F.col("_s1")), T.jaccard_distance(F.col("_set"), F.col("_s2")))
    gap = F.least(F.abs(F.col("_len") - F.col("_l1")), F.abs(F.col("_len") - F.col("_l2")))
    three = last.withColumn("_r3", _first([F.desc(far), F.desc(gap), F.desc("dup_count"), line, "ord"])).where("_r3 = 1")
    out = None
    for k, (part, why) in enumerate(((one, "frequency_representative"), (two, "complex_sample"), (three, "diverse_sample")), 1):
        part = part.select(*clustered.columns, "cluster_keep_k", F.lit(k).alias("selected_rank"), F.lit(why).alias("selection_reason"))
        out = part if out is None else out.unionByName(part)
    return out


def in_order(selected: DataFrame) -> DataFrame:
    """A selection as its file lists it: by dataset, cluster, rank and line number."""
    return selected.orderBy("dataset", "cluster_id", "selected_rank", "line_id")


def representative_only(rows: DataFrame) -> DataFrame:
    """The most frequent row of each cluster."""
    one = rows.withColumn("_r", _first([F.desc("dup_count"), "line_id", "ord"])).where("_r = 1").drop("_r")
    return one.withColumns({"cluster_keep_k": F.lit(1), "selected_rank": F.lit(1), "selection_reason": F.lit("frequency_representative")})


def _materialized(picked: DataFrame, reason: str) -> DataFrame:
    """Rank in the order of picking, and the number picked, of each cluster."""
    by = W.partitionBy("dataset", "cluster_id")
    cols = [c for c in picked.columns if c not in ("_pick", "cluster_keep_k", "selected_rank", "selection_reason")]
    return picked.select(*cols, F.count("*").over(by).cast("int").alias("cluster_keep_k"), F.row_number().over(by.orderBy("_pick")).alias("selected_rank"), F.lit(reason).alias("selection_reason"))


def _indexed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(W.partitionBy("dataset").orderBy("ord")) - 1)


def random_global(rows: DataFrame, counts: dict[str, int], seed: int) -> DataFrame:
    """As many rows of each dataset as counts says, drawn by Python's generator: it chooses places only, so the places are
    drawn on the driver and joined. For banks of a few thousand rows, as the selection they compare with."""
    sizes = {r["dataset"]: r["n"] for r in rows.groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    drawn = []
    for name, want in counts.items():
        if want > sizes.get(name, 0):
            raise ValueError(f"{name}: {want} rows wanted of {sizes.get(name, 0)}")
        drawn += [(name, i, k) for k, i in enumerate(random.Random(seed).sample(range(sizes[name]), want))]
    places = rows.sparkSession.createDataFrame(drawn, "dataset string, _i int, _pick int")
    return _materialized(_indexed(rows).join(places, ["dataset", "_i"]).drop("_i"), "random_global_sample")


def random_cluster(rows: DataFrame, seed: int) -> DataFrame:
    """cluster_keep_k rows of each cluster, drawn by one generator for a dataset in the order of the clusters' first rows."""
    by = W.partitionBy("dataset", "cluster_id")
    placed = rows.withColumns({"_j": F.row_number().over(by.orderBy("ord")) - 1, "_first": F.min("ord").over(by)})
    sizes = placed.groupBy("dataset", "cluster_id").agg(F.count("*").alias("n"), F.min("_first").alias("f"), F.min_by("cluster_keep_k", "ord").alias("k")).orderBy("dataset", "f").collect()
    drawn, rng, at = [], None, None
    for r in sizes:
        if r["dataset"] != at:
            rng, at = random.Random(seed), r["dataset"]
        drawn += [(at, r["cluster_id"], j, p) for p, j in enumerate(rng.sample(range(r["n"]), min(r["k"], r["n"])))]
    places = rows.sparkSession.createDataFrame(drawn, "dataset string, cluster_id string, _j int, _pick int")
    return _materialized(placed.join(places, ["dataset", "cluster_id", "_j"]).drop("_j", "_first"), "random_cluster_sample")


def hashed_sample(rows: DataFrame, k: F.Column, salt: str = "") -> DataFrame:
    """k rows of each cluster in the order of the md5 of salt and line number: a draw that any engine repeats."""
    order = F.md5(F.concat(F.lit(salt), F.col("line_id").cast("string")))
    picked = rows.withColumn("_pick", _first([order, "line_id", "ord"])).where(F.col("_pick") <= k)
    return _materialized(picked, "hashed_sample")


def coverage(selected: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Per dataset what a selection covers; with the rows that it was made from, also the clusters that it leaves out. A
    dataset without any selected row counts then with zeros."""
    per = selected.groupBy("dataset", "cluster_id").agg(F.count("*").alias("k"), F.sum("dup_count").alias("w"), F.sum("normalized_unique_content_count").alias("u"))
    count = lambda c: F.count_if(c)
    found = per.groupBy("dataset").agg(
        F.sum("k").alias("selected_log_count"), F.count("*").alias("covered_cluster_count"), F.sum("w").alias("selected_dup_weight_sum"), F.sum("u").alias("selected_unique_content_sum"),
        count(F.col("k") == 1).alias("clusters_with_1_sample"), count(F.col("k") == 2).alias("clusters_with_2_sample"), count(F.col("k") >= 3).alias("clusters_with_3plus_sample"), F.max("k").alias("max_cluster_selected_count"),
    )
    if rows is None:
        return found
    whole = rows.select("dataset", "cluster_id").distinct().groupBy("dataset").agg(F.count("*").alias("cluster_count"))
    found = whole.join(found, "dataset", "left").na.fill(0)
    return found.withColumn("clusters_with_0_sample", F.col("cluster_count") - F.col("covered_cluster_count"))


def runs(strategies: list[str], seeds: list[int]) -> list[tuple[str, int | None, str]]:
    """(strategy, seed, run name): seeded strategies once for each seed."""
    out: list[tuple[str, int | None, str]] = []
    for s in strategies:
        out += [(s, x, f"{s}_seed{x}") for x in seeds] if s.startswith("random") else [(s, None, s)]
    return out


def selections(rows: DataFrame, strategies: list[str], seeds: list[int]) -> dict[str, DataFrame]:
    """The selection of each run: rows are clustered, and the counts to match are those of the balanced selection."""
    chosen = balanced(rows)
    out: dict[str, DataFrame] = {}
    for strategy, seed, name in runs(strategies, seeds):
        if strategy == "random_global_matched":
            counts = {r["dataset"]: r["n"] for r in chosen.groupBy("dataset").agg(F.count("*").alias("n")).collect()}  # a row for each dataset
            out[name] = random_global(rows, counts, seed)
        elif strategy == "random_cluster_matched":
            keep = chosen.groupBy("dataset", "cluster_id").agg(F.max("cluster_keep_k").alias("cluster_keep_k"))
            out[name] = random_cluster(rows.drop("cluster_keep_k").join(keep, ["dataset", "cluster_id"]), seed)
        elif strategy == "representative_only":
            out[name] = representative_only(rows)
        else:
            raise ValueError(f"unknown strategy: {strategy}")
    return out
