"""BM25 over a support bank: statistics, scores by an inverted index, and the best examples of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions import text as T

K1, B = 1.5, 0.75
#: Sums of floats differ in their last places with the order of their terms; ranks use scores rounded here.
DIGITS = 9


def retrieval_text(df: DataFrame, field: str = "content") -> Column:
    """The field that retrieval reads; content where another field is absent or blank."""
    if field == "content" or field not in df.columns:
        return F.col("content")
    return F.when(T.strip(F.coalesce(field, F.lit(""))) == "", F.col("content")).otherwise(F.col(field))


def postings(bank: DataFrame, field: str = "content") -> DataFrame:
    """(dataset, key, term, tf, length, avg_length, idf): the index of a bank whose rows have a key."""
    docs = bank.select("dataset", "key", T.query_tokens(retrieval_text(bank, field)).alias("t"))
    sizes = docs.select("dataset", "key", F.size("t").alias("length"))
    corpus = sizes.groupBy("dataset").agg(F.avg("length").alias("avg_length"), F.count("*").alias("n"))
    tf = docs.select("dataset", "key", F.explode("t").alias("term")).groupBy("dataset", "key", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("dataset", "term").agg(F.count("*").alias("df"))
    idf = F.ln(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return tf.join(df, ["dataset", "term"]).join(sizes, ["dataset", "key"]).join(corpus, "dataset").select("dataset", "key", "term", "tf", "length", "avg_length", idf.alias("idf"))


def stats(bank: DataFrame, field: str = "content") -> DataFrame:
    """(dataset, term, df, idf) of a bank."""
    p = postings(bank, field)
    return p.groupBy("dataset", "term").agg(F.count("*").alias("df"), F.first("idf").alias("idf"))


def top_k(queries: DataFrame, bank: DataFrame, k: int, order: list[str], field: str = "content", exclude_same_content: bool = True, skip_self: bool = False) -> DataFrame:
    """(dataset, query, key, score, rank): the k bank rows of the highest score for each query.

    Only rows that share a term are scored. A query with fewer than k of those is filled up with rows of score 0 in the
    order of ties; these come from the bank's first contents, as many as could ever be needed, so no query meets the whole
    bank. order: bank columns that break ties."""
    terms = queries.select("dataset", "query", F.explode(F.array_distinct(T.query_tokens(retrieval_text(queries, field)))).alias("term"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1.0 - B + B * F.col("length") / F.col("avg_length")))
    scored = terms.join(postings(bank, field), ["dataset", "term"]).groupBy("dataset", "query", "key").agg(F.round(F.sum(weight), DIGITS).alias("score"))
    held = bank.select("dataset", "key", F.col("content").alias("_bank"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    ties = [f"_o{i}" for i in range(len(order))]
    asked = queries.select("dataset", "query", F.col("content").alias("_asked"))
    hits = scored.join(held, ["dataset", "key"]).join(asked, ["dataset", "query"])
    if exclude_same_content:
        hits = hits.where("_bank <> _asked")
    if skip_self:
        hits = hits.where("key <> query")
    rank = lambda: F.row_number().over(W.partitionBy("dataset", "query").orderBy(F.desc("score"), *ties))
    best = hits.withColumn("rank", rank()).where(F.col("rank") <= k)
    have = best.groupBy("dataset", "query").agg(F.count("*").alias("_have"))
    short = asked.join(have, ["dataset", "query"], "left").where(F.coalesce("_have", F.lit(0)) < k)
    inside = F.row_number().over(W.partitionBy("dataset", "_bank").orderBy(*ties, "key"))
    heads = held.withColumn("_in", inside).where(F.col("_in") <= k)
    opening = heads.where("_in = 1").withColumn("_c", F.row_number().over(W.partitionBy("dataset").orderBy(*ties, "key"))).where(F.col("_c") <= 2 * k + 1).select("dataset", "_bank")
    spare = heads.join(opening, ["dataset", "_bank"]).drop("_in")
    fill = short.select("dataset", "query", "_asked").join(spare, "dataset").join(best.select("dataset", "query", "key"), ["dataset", "query", "key"], "left_anti").withColumn("score", F.lit(0.0))
    if exclude_same_content:
        fill = fill.where("_bank <> _asked")
    if skip_self:
        fill = fill.where("key <> query")
    cols = ["dataset", "query", "key", "score", *ties]
    return best.select(*cols).unionByName(fill.select(*cols)).withColumn("rank", rank()).where(F.col("rank") <= k).select("dataset", "query", "key", "score", "rank")


def demonstrations(best: DataFrame, bank: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, query, demos): the examples of each query in retrieval order, with further bank columns `more`; those
    without a template are left out, which leaves gaps in the ranks."""
    held = bank.select("dataset", "key", "line_id", "content", F.col("event_template").alias("template"), *more)
    rows = best.join(held, ["dataset", "key"]).where("template is not null and template <> ''")
    demo = F.struct("rank", "line_id", "content", "template", "score", *more)
    return rows.groupBy("dataset", "query").agg(F.array_sort(F.collect_list(demo)).alias("demos"))  # k at most
