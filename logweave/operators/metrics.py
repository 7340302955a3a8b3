"""Accuracy of parsed templates: grouping, parsing and template level, with averages and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def align(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """(dataset, truth, pred) of rows with the same line number; null templates become empty."""
    t = truth.select("dataset", F.col("line_id").cast("string").alias("line_id"), F.coalesce("event_template", F.lit("")).alias("truth"))
    p = parsed.select("dataset", F.col("line_id").cast("string").alias("line_id"), F.coalesce("predicted_template", F.lit("")).alias("pred"))
    return t.join(p, ["dataset", "line_id"]).select("dataset", "truth", "pred")


def align_by_place(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """The same by place in each dataset, up to the shorter one: for results without line numbers."""
    place = F.row_number().over(W.partitionBy("dataset").orderBy("ord"))
    t = truth.select("dataset", place.alias("i"), F.coalesce("event_template", F.lit("")).alias("truth"))
    p = parsed.select("dataset", place.alias("i"), F.coalesce("predicted_template", F.lit("")).alias("pred"))
    return t.join(p, ["dataset", "i"]).select("dataset", "truth", "pred")


def harmonic(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 0.0).otherwise(2 * a * b / (a + b))


def _pairs(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("dataset", "truth", "pred").agg(F.count("*").alias("n"))


def grouping(aligned: DataFrame) -> DataFrame:
    """GA and FGA: a truth group counts if all its rows have one prediction and that prediction has no others."""
    pairs = _pairs(aligned)
    preds = pairs.groupBy("dataset", "pred").agg(F.sum("n").alias("pred_rows"))
    truths = pairs.groupBy("dataset", "truth").agg(F.count("*").alias("k"), F.sum("n").alias("rows"), F.min("pred").alias("pred"))
    good = truths.join(preds, ["dataset", "pred"]).withColumn("ok", ((F.col("k") == 1) & (F.col("rows") == F.col("pred_rows"))).cast("long"))
    sums = good.groupBy("dataset").agg(F.sum(F.col("ok") * F.col("rows")).alias("ok_rows"), F.sum("rows").alias("rows"), F.sum("ok").alias("ok"), F.count("*").alias("truths"))
    out = sums.join(preds.groupBy("dataset").agg(F.count("*").alias("preds")), "dataset")
    return out.select("dataset", (F.col("ok_rows") / F.col("rows")).alias("GA"), harmonic(F.col("ok") / F.col("preds"), F.col("ok") / F.col("truths")).alias("FGA"))


def parsing(aligned: DataFrame) -> DataFrame:
    """PA: share of rows whose prediction is the truth."""
    return aligned.groupBy("dataset").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("PA"))


def template_level(aligned: DataFrame) -> DataFrame:
    """PTA, RTA, FTA: a predicted template counts if its rows' truths are exactly it; an empty one is a template, too."""
    pairs = _pairs(aligned)
    per = pairs.groupBy("dataset", "pred").agg(F.min("truth").alias("a"), F.max("truth").alias("b"))
    ok = per.groupBy("dataset").agg(F.sum(((F.col("a") == F.col("pred")) & (F.col("b") == F.col("pred"))).cast("long")).alias("ok"), F.count("*").alias("identified_templates"))
    truths = pairs.groupBy("dataset").agg(F.countDistinct("truth").alias("ground_templates"))
    p, r = F.col("ok") / F.col("identified_templates"), F.col("ok") / F.col("ground_templates")
    return ok.join(truths, "dataset").select("dataset", "identified_templates", "ground_templates", p.alias("PTA"), r.alias("RTA"), harmonic(p, r).alias("FTA"))


def filtered(aligned: DataFrame, only: DataFrame) -> DataFrame:
    """GA, FGA, PA, PTA, RTA and FTA over the truth templates in `only` (dataset, truth); groups are judged on all rows."""
    wanted = only.select("dataset", "truth").distinct()
    pairs = _pairs(aligned).join(wanted.withColumn("in", F.lit(1)), ["dataset", "truth"], "left").withColumn("in", F.coalesce("in", F.lit(0)))
    preds = pairs.groupBy("dataset", "pred").agg(F.sum("n").alias("pred_rows"), F.max("in").alias("seen"), F.min("truth").alias("a"), F.max("truth").alias("b"))
    truths = pairs.groupBy("dataset", "truth").agg(F.count("*").alias("k"), F.sum("n").alias("rows"), F.min("pred").alias("pred"), F.max("in").alias("in"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("same"))
    good = truths.where("in = 1").join(preds, ["dataset", "pred"]).withColumn("ok", ((F.col("k") == 1) & (F.col("rows") == F.col("pred_rows"))).cast("long"))
    g = good.groupBy("dataset").agg(F.sum(F.col("ok") * F.col("rows")).alias("ok_rows"), F.sum("rows").alias("rows"), F.sum("ok").alias("ok"), F.sum("same").alias("same"))
    right = wanted.withColumnRenamed("truth", "pred").withColumn("listed", F.lit(1))
    t = preds.where("seen = 1 or a = pred").join(right, ["dataset", "pred"], "left").groupBy("dataset").agg(F.sum(((F.col("a") == F.col("pred")) & (F.col("b") == F.col("pred")) & F.col("listed").isNotNull()).cast("long")).alias("t_ok"), F.sum("seen").alias("preds"))
    n = wanted.groupBy("dataset").agg(F.count("*").alias("n"))
    out = g.join(t, "dataset").join(n, "dataset")
    ratio = lambda a, b: F.col(a) / F.col(b)
    return out.select(
        "dataset", ratio("ok_rows", "rows").alias("GA"), ratio("same", "rows").alias("PA"), harmonic(ratio("ok", "preds"), ratio("ok", "n")).alias("FGA"),
        ratio("t_ok", "preds").alias("PTA"), ratio("t_ok", "n").alias("RTA"), harmonic(ratio("t_ok", "preds"), ratio("t_ok", "n")).alias("FTA"),
    )


METRICS = ("GA", "PA", "FGA", "PTA", "RTA", "FTA")


def evaluate(aligned: DataFrame) -> DataFrame:
    """All metrics of each dataset. The driver's report rounds; these are the raw numbers."""
    return grouping(aligned).join(parsing(aligned), "dataset").join(template_level(aligned), "dataset").select("dataset", "identified_templates", "ground_templates", *METRICS)


def with_average(summary: DataFrame, digits: int = 3) -> DataFrame:
    """Summary rows once for each dataset, and a row Average of the numeric columns, which are percentages of one place."""
    numeric = [c for c, t in summary.dtypes if t in ("double", "bigint", "int")]
    one = summary.dropDuplicates(["dataset"]).select("dataset", *[F.col(c).cast("double").alias(c) for c in numeric])
    mean = one.agg(*[F.round(F.avg(c), digits).alias(c) for c in numeric]).select(F.lit("Average").alias("dataset"), *numeric)
    return one.unionByName(mean)


def transposed(summary: DataFrame) -> DataFrame:
    """(metric, dataset, value) of a summary."""
    numeric = [c for c, t in summary.dtypes if t == "double"]
    return summary.unpivot(["dataset"], numeric, "metric", "value")


def parse_stats(predictions: DataFrame) -> DataFrame:
    """Counters of each dataset by where its predictions come from."""
    hit = lambda s: F.count_if(F.col("decision_source") == s)
    exact, sign, pat = hit("exact_cache"), hit("signature_cache"), hit("pattern_cache")
    return predictions.groupBy("dataset").agg(
        F.count("*").alias("total_logs"), (exact + sign + pat).alias("cache_hits"), exact.alias("exact_hits"), sign.alias("signature_hits"), pat.alias("pattern_hits"),
        (hit("llm") + hit("failed")).alias("llm_calls"), hit("llm").alias("llm_valid"), hit("failed").alias("failed"),
    )


def overall(stats: DataFrame, value: str, weight: str = "total_logs") -> DataFrame:
    """Number of datasets, total weight, plain and weighted average of a value; 0 without weight."""
    w = F.sum(weight)
    return stats.agg(F.count("*").alias("dataset_count"), w.alias("total_logs"), F.avg(value).alias("macro_average"), F.when(w == 0, 0.0).otherwise(F.sum(F.col(value) * F.col(weight)) / w).alias("weighted_average"))


def resources(samples: DataFrame, interval: float) -> DataFrame:
    """Per device: largest and mean memory and power, and watt hours of samples taken every `interval` seconds."""
    return samples.groupBy("device").agg(F.max("memory_mb").alias("max_memory_mb"), F.avg("memory_mb").alias("avg_memory_mb"), F.max("power_w").alias("max_power_w"), F.avg("power_w").alias("avg_power_w"), (F.sum("power_w") * interval / 3600.0).alias("energy_wh"))
