"""Training records with few-shot examples: variants, lite query choice, records and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.operators.retrieve import demonstrations, top_k

KINDS = ("trivial", "single_var", "medium", "complex", "very_complex")


def variants(spark: SparkSession, max_shots: int) -> DataFrame:
    """(variant_name, variant_type, shot): one shot count alone, and 0 up to each count."""
    rows = [(f"{s}-shot-only", "shot-only", s) for s in range(max_shots + 1)]
    rows += [(f"0-{m}-shot", "progressive", s) for m in range(1, max_shots + 1) for s in range(m + 1)]
    return spark.createDataFrame(rows, "variant_name string, variant_type string, shot int")


def lite_decisions(samples: DataFrame) -> DataFrame:
    """(dataset, cluster_id, kind, keep_count) by how complex the longest texts of a cluster are."""
    # fixed values: limits on text length, signs and tokens
    order = F.struct(F.length("normalized_content"), -F.col("selected_rank"), -F.col("line_id"), -F.col("ord"))
    longest = F.max_by("normalized_content", order).alias("text")
    c = samples.groupBy("dataset", "cluster_id").agg(longest, F.max(F.length("content")).alias("length"), F.count("*").cast("int").alias("rows"))
    marks = F.regexp_extract_all("text", F.lit(r"<([a-z_]+)>"), F.lit(1))
    c = c.withColumns({"marks": F.size(marks), "kinds": F.size(F.array_distinct(marks)), "toks": F.size(T.query_tokens(F.col("text"))), "signs": T.symbols(F.col("text"), "<>")})
    simple = (F.col("marks") == 1) & (F.col("toks") <= 12) & (F.col("signs") <= 5) & (F.col("length") < 120)
    very = (F.col("marks") >= 5) | (F.col("toks") >= 24) | (F.col("signs") >= 12) | (F.col("length") >= 180)
    some = (F.col("marks") >= 3) | (F.col("kinds") >= 2) | (F.col("signs") >= 8) | (F.col("toks") >= 16) | (F.col("length") >= 120)
    kind = F.when(F.col("marks") == 0, "trivial").when(simple, "single_var").when(very, "very_complex").when(some, "complex").otherwise("medium")
    most = F.when(F.col("kind") == "trivial", 0).when(F.col("kind") == "very_complex", 3).when(F.col("kind") == "complex", 2).otherwise(1)
    return c.withColumn("kind", kind).select("dataset", "cluster_id", "kind", F.least(most, F.col("rows")).alias("keep_count"))


def lite_queries(samples: DataFrame) -> DataFrame:
    """The leading rows of each cluster that the decisions keep."""
    rank = F.row_number().over(W.partitionBy("dataset", "cluster_id").orderBy("selected_rank", "line_id", "ord"))
    kept = samples.withColumn("_r", rank).join(lite_decisions(samples), ["dataset", "cluster_id"]).where(F.col("_r") <= F.col("keep_count"))
    return kept.select(*samples.columns)


def lite_summary(samples: DataFrame) -> DataFrame:
    """Clusters of each kind, rows, queries kept and their ratio (six places, half to even), by dataset and in total. No
    rows, no summary."""
    sizes = samples.groupBy("dataset", "cluster_id").agg(F.count("*").alias("rows"))
    d = lite_decisions(samples).join(sizes, ["dataset", "cluster_id"])
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_cluster_count") for k in KINDS]
    out = d.rollup("dataset").agg(F.sum("rows").alias("retrieval_log_count"), F.sum("keep_count").alias("query_sample_count"), *counts)
    ratio = F.bround(F.col("query_sample_count").cast("decimal(18,0)") / F.col("retrieval_log_count").cast("decimal(18,0)"), 6).cast("decimal(18,6)").cast("string")
    return out.withColumns({"dataset": F.coalesce("dataset", F.lit("TOTAL")), "query_ratio": ratio})


def examples(samples: DataFrame, max_shots: int, field: str = "content") -> DataFrame:
    """The best other samples of the same dataset for each sample; ties by line number and order."""
    keyed = samples.withColumn("key", F.col("ord"))
    return top_k(keyed.withColumn("query", F.col("ord")), keyed, max_shots, ["line_id", "ord"], field, exclude_same_content=False, skip_self=True)


def _named(samples: DataFrame) -> DataFrame:
    """Samples with event_id (of their template) and cluster_id (null) where they lack them."""
    if "event_id" not in samples.columns:
        samples = samples.withColumn("event_id", T.event_id(F.coalesce("event_template", F.lit(""))))
    return samples if "cluster_id" in samples.columns else samples.withColumn("cluster_id", F.lit(None).cast("string"))


def records(queries: DataFrame, samples: DataFrame, max_shots: int = 5, form: str = "instruction", field: str = "content") -> DataFrame:
    """One record for each query, variant and shot, with its metadata; examples stand in reverse, the best last."""
    keyed = _named(samples).withColumn("key", F.col("ord"))
    shown = demonstrations(examples(samples, max_shots, field), keyed, ("event_id", "cluster_id"))
    none = F.expr(f"cast(array() as {dict(shown.dtypes)['demos']})")
    asked = _named(queries).join(shown.withColumnRenamed("query", "ord"), ["dataset", "ord"], "left").withColumn("demos", F.coalesce("demos", none))
    named = variants(queries.sparkSession, max_shots)
    many = asked.join(F.broadcast(named))  # a dozen rows by the number of shots
    used = many.withColumn("used", F.reverse(F.slice("demos", 1, F.col("shot"))) if max_shots else F.col("demos"))
    make = {"instruction": T.instruction_record, "chat": T.chat_record}[form]
    given = lambda c: F.transform("used", lambda d: d[c])
    each = {"line_id": "example_line_ids", "event_id": "example_event_ids", "cluster_id": "example_cluster_ids", "score": "example_bm25_scores"}
    return used.select(
        "variant_name", "variant_type", "shot", "dataset", "line_id", "event_id", "cluster_id", make(F.col("content"), F.col("event_template"), F.col("used")).alias("record"),
        *[given(c).alias(name) for c, name in each.items()],
    )


def experiment_summary(queries: DataFrame, samples: DataFrame, max_shots: int = 5, form: str = "instruction", field: str = "content", mode: str = "full") -> DataFrame:
    """Counts of samples, queries and records of each variant and dataset; a dataset without queries counts 0."""
    spec = variants(samples.sparkSession, max_shots).groupBy("variant_name", "variant_type").agg(F.array_sort(F.collect_list("shot")).alias("shots"))
    held = samples.groupBy("dataset").agg(F.count("*").alias("retrieval_log_count"))
    asked = queries.groupBy("dataset").agg(F.count("*").alias("query_log_count"))
    both = held.join(asked, "dataset", "left").na.fill(0, ["query_log_count"]).join(F.broadcast(spec))  # a row for each dataset
    return both.select(
        "variant_name", "variant_type", F.array_join(F.col("shots").cast("array<string>"), ",").alias("shot_numbers"), "dataset", "retrieval_log_count", "query_log_count",
        (F.col("query_log_count") * F.size("shots")).alias("jsonl_record_count"), F.lit(field).alias("retrieval_field"), F.lit(form).alias("output_format"), F.lit(mode).alias("query_mode"),
    )


def generate_all(samples: DataFrame, path: str, max_shots: int = 5, form: str = "instruction", field: str = "content", mode: str = "full", metadata: bool = True, by_dataset: bool = False) -> None:
    """Write under path: `train` (JSON lines, a directory for each variant), `metadata` alike, `experiment_summary` and,
    in lite mode, `lite_query_summary` (CSV). With by_dataset each variant has a directory for each dataset."""
    if mode not in ("full", "lite"):
        raise ValueError(f"unknown query mode: {mode}")
    queries = lite_queries(samples) if mode == "lite" else samples
    rows = records(queries, samples, max_shots, form, field)
    parts = ["variant_name", *(["dataset"] if by_dataset else [])]
    rows.select(*parts, F.col("record").alias("value")).write.mode("overwrite").partitionBy(*parts).text(f"{path}/train")
    if metadata:
        # the directory's names repeat as fields of each line
        folders = {f"{c}_dir": F.col(c) for c in parts}
        rows.drop("record").withColumns(folders).write.mode("overwrite").partitionBy(*folders).json(f"{path}/metadata")
    summaries = {"experiment_summary": experiment_summary(queries, samples, max_shots, form, field, mode)}
    if mode == "lite":
        summaries["lite_query_summary"] = lite_summary(samples)
    for name, table in summaries.items():
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")  # a row for each variant and dataset
