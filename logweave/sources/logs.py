"""Log tables: CSV directories, views over the star-schema tables, and sinks.

Every view has the columns dataset, ord (unique in its dataset), line_id, content and event_template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import text as T

VIEW = ("dataset", "ord", "line_id", "content", "event_template")
REQUIRED = ("LineId", "Content")
LINES = 100_000_000
PREFERRED = ("dataset", "total_logs", "cache_hits", "exact_hits", "signature_hits", "pattern_hits", "llm_calls", "llm_valid", "llm_invalid", "failed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset_names(spark: SparkSession, root: str, names: list[str] | None = None, expected: int | None = None) -> list[str]:
    """Sub-directories of root, sorted; a wrong number or an unknown name is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
    if expected is not None and len(found) != expected:
        raise ValueError(f"{root} has {len(found)} datasets, not {expected}")
    if names is None:
        return found
    missing = sorted(set(names) - set(found))
    if missing:
        raise ValueError(f"unknown datasets: {', '.join(missing)}")
    return [x for x in found if x in set(names)]


def structured_file(spark: SparkSession, root: str, dataset: str, suffix: str = "_structured.csv") -> str:
    """The one file of a dataset with the suffix."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/{dataset}/*{suffix}")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    if len(found) != 1:
        raise ValueError(f"{len(found)} files *{suffix} in {root}/{dataset}, not one")
    return found[0].getPath().toString()


def read_structured(spark: SparkSession, root: str, names: list[str] | None = None, required: tuple[str, ...] = REQUIRED, suffix: str = "_structured.csv", expected: int | None = None) -> DataFrame:
    """All columns as strings, null as empty, with dataset and ord (file order); rows that are wholly empty are skipped."""
    out = None
    for name in dataset_names(spark, root, names, expected):
        df = spark.read.csv(structured_file(spark, root, name, suffix), header=True, quote='"', escape='"', multiLine=True, maxCharsPerColumn=-1, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"{name}: missing columns {', '.join(missing)}")
        df = df.select(F.lit(name).alias("dataset"), F.monotonically_increasing_id().alias("ord"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no dataset in {root}")
    return out


def as_view(df: DataFrame) -> DataFrame:
    """A structured table as a log view; other columns go into the map `extra`."""
    known = {"dataset", "ord", "LineId", "Content", "EventTemplate"}
    extra = [x for c in df.columns if c not in known for x in (F.lit(c), F.col(f"`{c}`"))]
    template = F.col("EventTemplate") if "EventTemplate" in df.columns else F.lit(None).cast("string")
    return df.select("dataset", "ord", T.line_number(F.col("LineId")).alias("line_id"), F.col("Content").alias("content"), template.alias("event_template"), (F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")).alias("extra"))


def head(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows of each dataset in file order; all without n."""
    if n is None:
        return df
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("dataset").orderBy("ord"))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents; dataset is their source. Places leave room for LINES lines a document; more are an error,
    never another document's places."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    order = F.col("doc_id") * LINES + F.when(F.col("pos") < LINES, F.col("pos")).otherwise(F.raise_error(F.lit("a document has too many lines")).cast("int"))
    return docs.select("dataset", order.alias("ord"), (order + 1).alias("line_id"), "content", F.lit(None).cast("string").alias("event_template"))


def _shape(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line for each event, in six shapes by event_id % 6, with its true template; dataset is the event type."""
    e = table(spark, sf_dir, "events")
    i, u, k = F.col("event_id"), F.col("user_id"), F.col("event_type")
    ms, port = i % 97, i % 7
    shapes = [
        (_shape("user ", u, " did ", k, " in ", ms, " ms"), _shape("user <*> did ", k, " in <*> ms")),
        (_shape("session opened for user ", u, " via ", k), _shape("session opened for user <*> via ", k)),
        (_shape(k, " request took ", ms, " ms, user ", u), _shape(k, " request took <*> ms, user <*>")),
        (_shape("connection from 10.0.0.", port, " closed by user ", u), _shape("connection from <*> closed by user <*>")),
        (_shape("cache refreshed after ", k), _shape("cache refreshed after ", k)),
        (_shape("write of ", ms, " bytes to /data/", k, " failed, error code ", port), _shape("write of <*> bytes to <*> failed, error code <*>")),
    ]
    pick = lambda j: F.coalesce(*[F.when(i % 6 == n, s[j]) for n, s in enumerate(shapes)])
    return e.select(k.alias("dataset"), i.alias("ord"), (i + 1).alias("line_id"), pick(0).alias("content"), pick(1).alias("event_template"))


#: The same view in SQL that both engines read.
LOG_EVENTS_SQL = """
select event_type as dataset, event_id as ord, event_id + 1 as line_id,
  case event_id % 6
    when 0 then 'user ' || user_id || ' did ' || event_type || ' in ' || (event_id % 97) || ' ms'
    when 1 then 'session opened for user ' || user_id || ' via ' || event_type
    when 2 then event_type || ' request took ' || (event_id % 97) || ' ms, user ' || user_id
    when 3 then 'connection from 10.0.0.' || (event_id % 7) || ' closed by user ' || user_id
    when 4 then 'cache refreshed after ' || event_type
    else 'write of ' || (event_id % 97) || ' bytes to /data/' || event_type || ' failed, error code ' || (event_id % 7) end as content,
  case event_id % 6
    when 0 then 'user <*> did ' || event_type || ' in <*> ms'
    when 1 then 'session opened for user <*> via ' || event_type
    when 2 then event_type || ' request took <*> ms, user <*>'
    when 3 then 'connection from <*> closed by user <*>'
    when 4 then 'cache refreshed after ' || event_type
    else 'write of <*> bytes to <*> failed, error code <*>' end as event_template
from events"""


def log_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.lit("pages").alias("dataset"), F.col("page_id").alias("ord"), (F.col("page_id") + 1).alias("line_id"), F.col("url").alias("content"), F.lit(None).cast("string").alias("event_template"))


def log_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    content = _shape("order ", F.col("o_orderkey"), " status ", F.col("o_orderstatus"), " priority ", F.col("o_orderpriority"))
    template = _shape("order <*> status ", F.col("o_orderstatus"), " priority ", F.col("o_orderpriority"))
    return o.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("line_id"), content.alias("content"), template.alias("event_template"))


def log_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shapes by customer: one whose lines differ in a token of ten, one whose lines differ in a token of five."""
    c = table(spark, sf_dir, "customer")
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    side = F.element_at(F.array(*[F.lit(x) for x in ("east", "north", "south", "west")]), (k % 4 + 1).cast("int"))
    content = F.when(k % 3 == 0, _shape("notice ", segment, " for ", side, " now")).otherwise(_shape("customer ", k, " of segment ", segment, " in nation ", F.col("c_nationkey"), " opened account"))
    return c.select(_shape("accounts", F.col("c_nationkey") % 3).alias("dataset"), k.alias("ord"), (k + 1).alias("line_id"), content.alias("content"), F.lit(None).cast("string").alias("event_template"))


def scoped(logs: DataFrame, banks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Logs and support rows with the scope that joins them: a dataset's own bank, or all banks together under `*`.

    A scope that no bank serves is an error for its logs, found when they are read."""
    asked = logs.withColumn("scope", T.support_scope(F.col("dataset")))
    held = banks.withColumn("scope", F.explode(F.array(F.col("dataset"), F.lit("*"))))
    known = F.broadcast(held.select("scope").distinct().withColumn("_known", F.lit(True)))  # a row for each dataset
    missing = F.raise_error(F.concat(F.lit("no support bank for "), F.col("scope"))).cast("string")
    served = asked.join(known, "scope", "left").withColumn("scope", F.when(F.col("_known"), F.col("scope")).otherwise(missing)).drop("_known")
    return served, held.join(asked.select("scope").distinct(), "scope", "left_semi")


def bank(logs: DataFrame) -> DataFrame:
    """The first log of each dataset and template: a support set for retrieval."""
    return logs.groupBy("dataset", "event_template").agg(F.min(F.struct("ord", "line_id", "content")).alias("r")).select("dataset", "r.ord", "r.line_id", "r.content", "event_template")


def write_jsonl(df: DataFrame, record: Column, path: str) -> None:
    """One compact JSON record a line; other scripts than Latin stay as they are."""
    df.select(record.alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, by_dataset: bool = True) -> None:
    """Published by the commit protocol as a whole; one directory for each dataset."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    (writer.partitionBy("dataset") if by_dataset and "dataset" in df.columns else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A summary as JSON records."""
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, n: int | None = None, schema: str | None = None) -> DataFrame:
    """JSON lines, the first n of them if n is given (a feature of the loader: any n rows of a directory of parts)."""
    df = (spark.read.schema(schema) if schema else spark.read).json(path)
    return df if n is None else df.limit(n)


def eval_split(rows: DataFrame, share: float, seed: int, key: str = "ord", least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(train, eval): rows whose seeded hash falls under the share go to eval; no split under `least` rows."""
    if rows.limit(least).count() < least:
        return rows, rows.limit(0)
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30))
    return rows.where(~drawn), rows.where(drawn)


def structured_result(spark: SparkSession, root: str, dataset: str) -> str:
    """The result file of a dataset: in a directory of its own, or in the root."""
    jvm = spark.sparkContext._jvm
    for path in (f"{root}/{dataset}/{dataset}_full.log_structured.csv", f"{root}/{dataset}_full.log_structured.csv"):
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(f"no result of {dataset} in {root}")


def export_predictions(predictions: DataFrame) -> DataFrame:
    """Predictions as a structured table: LineId, Content, EventId, EventTemplate."""
    return predictions.select("dataset", F.col("line_id").cast("string").alias("LineId"), F.col("content").alias("Content"), T.event_id(F.col("predicted_template")).alias("EventId"), F.col("predicted_template").alias("EventTemplate"))


def union_summaries(parts: list[DataFrame]) -> DataFrame:
    """Summaries with different columns as one; the usual columns come first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    first = [c for c in PREFERRED if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def parse_seconds(summary: DataFrame) -> DataFrame:
    """Parse time in seconds from a summary with total_latency_ms; null where it is absent."""
    ms = F.col("total_latency_ms").cast("double") if "total_latency_ms" in summary.columns else F.lit(None).cast("double")
    return summary.select(*[c for c in ("dataset",) if c in summary.columns], (ms / 1000.0).alias("parse_time"))


def names_from(text: str | None) -> list[str] | None:
    """A comma list: stripped, empty parts gone, each once; None if nothing is left."""
    found = list(dict.fromkeys(x.strip() for x in (text or "").split(",") if x.strip()))
    return found or None


def ints_from(text: str) -> list[int]:
    """A comma list of whole numbers; an empty list is an error."""
    found = [int(x) for x in names_from(text) or []]
    if not found:
        raise ValueError("no number given")
    return found
