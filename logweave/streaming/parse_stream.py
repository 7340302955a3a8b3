"""Structured Streaming forms of the log operators.

The online mode is one ordered pass; here the same caches live in the state of a keyed stream, so each
micro-batch goes on from where the last one ended. Look-ups against a fixed bank need no state at all."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweave.functions import text as T
from logweave.plans.parse import TemplateCaches, fold, signature_generator

OUT = "dataset string, ord bigint, line_id bigint, content string, predicted_template string, decision_source string"


def read_logs(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parse_stream(logs: DataFrame, generator: Callable[[Column], Column] = signature_generator, **sizes: int | str) -> DataFrame:
    """Predictions of a stream of logs by the ordered mode; the caches of each dataset are its state."""
    made = logs.select("dataset", "ord", "line_id", "content", T.signature(F.col("content")).alias("_sig"), T.extract_template(generator(F.col("content"))).alias("_made"))

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        caches = pickle.loads(state.get[0]) if state.exists else TemplateCaches(**sizes)  # written by this function only
        pdf = pd.concat(list(pdfs)).sort_values("ord")
        done = fold(zip(pdf["content"], pdf["_sig"], pdf["_made"], strict=True), caches)
        state.update((pickle.dumps(caches),))
        yield pdf[["dataset", "ord", "line_id", "content"]].assign(predicted_template=[t for t, _ in done], decision_source=[s for _, s in done])

    return made.groupBy("dataset").applyInPandasWithState(run, OUT, "caches binary", "append", GroupStateTimeout.NoTimeout)


def first_seen(logs: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Exact deduplication of a stream: the first row of each dataset and content within the watermark."""
    return logs.withWatermark(time, late).dropDuplicatesWithinWatermark(["dataset", "content"])


def template_counts(predictions: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Logs of each template in tumbling windows of event time."""
    return predictions.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "dataset", "predicted_template").agg(F.count("*").alias("n"))
