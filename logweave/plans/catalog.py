"""Names of the queries, their functions and the SQL that DuckDB checks them with.

The SQL is written on its own for each query: it shares only the text of the view `log_events` with the Spark side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import templates as P
from logweave.functions import text as T
from logweave.operators import cluster, dedup, fewshot, metrics, retrieve, select
from logweave.plans import parse
from logweave.sources import logs as L

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- shared pieces of the SQL side --------------------------------------------------------------------------------

EVENTS = f"with ev as ({L.LOG_EVENTS_SQL})"
LINES = """with lines as (select source as dataset, doc_id, doc_id * 100000000 + unnest(range(len(string_split(text, chr(10))))) as ord,
  unnest(string_split(text, chr(10))) as content from documents)"""
NORM = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\b([0-9]{1,3}\.){3}[0-9]{1,3}\b', ' <IP> ', 'g'),
  '/data/[a-z_]+', ' <PATH> ', 'g'), '\b[0-9]+\b', ' <NUM> ', 'g'), '\s+', ' ', 'g')))"""
SIGN = r"""regexp_replace(regexp_replace(content, '\b([0-9]{1,3}\.){3}[0-9]{1,3}\b', '<*>', 'g'), '\b[0-9]+\b', '<*>', 'g')"""
TOKENS = r"regexp_extract_all(%s, '<[a-z_]+>|[A-Za-z_]+|[0-9]+|[^\sA-Za-z_0-9]')"
#: Clusters for the selection queries: rows of one dataset and signature; exact duplicates merged before.
PROXY = f"""{EVENTS}, exact as (select dataset, content, min(ord) as ord, min(line_id) as line_id, count(*) as dup_count from ev group by dataset, content),
 named as (select *, {NORM} as normalized_content, dataset || ':' || {SIGN} as cluster_id, 1 as normalized_unique_content_count from exact),
 cl as (select *, count(*) over c as n, sum(dup_count) over c as weight from named window c as (partition by dataset, cluster_id))"""
#: The support bank: the first log of each dataset and template.
BANK = f"""{EVENTS}, bank as (select dataset, event_template, min(ord) as ord, arg_min(line_id, ord) as line_id, arg_min(content, ord) as content from ev group by dataset, event_template)"""


def _proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.exact(L.log_events(spark, sf_dir)).withColumns({
        "normalized_content": T.normalize(F.col("content")),
        "cluster_id": F.concat("dataset", F.lit(":"), T.signature(F.col("content"))),
        "normalized_unique_content_count": F.lit(1),
    })
    sums = rows.groupBy("dataset", "cluster_id").agg(F.count("*").alias("cluster_size_unique"), F.sum("dup_count").alias("cluster_weight_dup_sum"))
    return rows.join(sums, ["dataset", "cluster_id"])


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bank(L.log_events(spark, sf_dir))


# --- deduplication and splits -------------------------------------------------------------------------------------


@_query(f"{LINES} select dataset, content, min(ord) as ord, count(*) as dup_count from lines group by dataset, content")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(L.log_lines(spark, sf_dir)).select("dataset", "content", "ord", "dup_count")


@_query(f"""{EVENTS}, exact as (select dataset, content, min(ord) as ord, min(line_id) as line_id, count(*) as dup_count from ev group by dataset, content),
 named as (select *, {NORM} as normalized_content from exact)
 select dataset, normalized_content, arg_max(content, (dup_count, -line_id, -ord)) as content, arg_max(line_id, (dup_count, -line_id, -ord)) as line_id, min(ord) as ord,
  cast(sum(dup_count) as bigint) as dup_count, count(*) as normalized_unique_content_count from named group by dataset, normalized_content""")
def normalized_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.normalized(dedup.exact(L.log_events(spark, sf_dir)))
    return out.select("dataset", "normalized_content", "content", "line_id", "ord", "dup_count", "normalized_unique_content_count")


@_query(f"{LINES} select dataset, count(distinct content) as unique_count, count(*) as original_log_count from lines group by dataset")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.summary(dedup.exact(L.log_lines(spark, sf_dir)))


@_query()
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.log_lines(spark, sf_dir).select("dataset", "ord", T.normalize(F.col("content")).alias("normalized_content"))


@_query(f"""{LINES} select dataset, ord, content from lines l where not exists
 (select 1 from lines t where t.doc_id % 10 = 0 and t.dataset = l.dataset and t.content = l.content)""")
def test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = L.log_lines(spark, sf_dir)
    return dedup.test_split(full, full.where("floor(ord / 100000000) % 10 = 0")).select("dataset", "ord", "content")


@_query(f"""{LINES}, t as (select distinct dataset, content from lines where doc_id % 10 = 0),
 k as (select dataset, count(*) as known from t group by dataset)
 select l.dataset, count(*) as full_count, coalesce(max(k.known), 0) as unique_train_contents, count(t.content) as removed_count, count(*) - count(t.content) as test_count
 from lines l left join t on t.dataset = l.dataset and t.content = l.content left join k on k.dataset = l.dataset group by l.dataset""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = L.log_lines(spark, sf_dir)
    return dedup.split_summary(full, full.where("floor(ord / 100000000) % 10 = 0"))


# --- tokens, signatures, clusters ---------------------------------------------------------------------------------


@_query(f"""{EVENTS}, t as (select dataset, ord, {TOKENS % NORM} as toks from ev), s as (select *, list_filter(toks, lambda x: not regexp_full_match(x, '<[a-z_]+>')) as st from t)
 select dataset, ord, len(toks) as n_tokens, coalesce(st[1], '') || '|' || coalesce(st[2], '') as head, coalesce(st[len(st)], '') as tail, array_to_string(toks, ' ') as tokens from s""")
def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(T.normalize(F.col("content")))
    rows = L.log_events(spark, sf_dir).select("dataset", "ord", t.alias("t")).withColumn("b", T.bucket_key(F.col("t")))
    return rows.select("dataset", "ord", F.col("b.n").cast("long").alias("n_tokens"), "b.head", "b.tail", F.array_join("t", " ").alias("tokens"))


@_query(f"{EVENTS} select dataset, {SIGN} as signature, count(*) as n, min(ord) as first_ord, count(distinct content) as contents from ev group by 1, 2")
def signature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.log_events(spark, sf_dir).select("dataset", "ord", "content", T.signature(F.col("content")).alias("signature"))
    return rows.groupBy("dataset", "signature").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.countDistinct("content").alias("contents"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster(dedup.normalized(dedup.exact(L.log_events(spark, sf_dir))))


@_query()
def cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir)


@_query()
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_summary(_clustered(spark, sf_dir))


#: In `log_accounts` lines of the first shape differ in one token of ten (0.9 alike), those of the second in one of five
#: (0.8), so the first make one cluster and the second one for each text.
ACCOUNTS = """with ac as (select 'accounts' || (c_nationkey % 3) as dataset, c_custkey as ord, c_custkey % 3 = 0 as apart, lower(c_mktsegment) as seg,
  ['east', 'north', 'south', 'west'][c_custkey % 4 + 1] as side,
  case when c_custkey % 3 = 0 then 'notice ' || c_mktsegment || ' for ' || side || ' now' else 'customer ' || c_custkey || ' of segment ' || c_mktsegment || ' in nation ' || c_nationkey || ' opened account' end as content from customer),
 nz as (select dataset, apart, case when apart then 'notice ' || seg || ' for ' || side || ' now' else 'customer <num> of segment ' || seg || ' in nation <num> opened account' end as normalized_content,
  min(ord) as ord, count(*) as dup_count, count(distinct content) as u, arg_min(content, ord) as first_content from ac group by all),
 gr as (select *, case when apart then normalized_content else '' end as g from nz),
 cc as (select dataset, g, min(ord) as first, cast(sum(u) as bigint) as cluster_size_unique, cast(sum(dup_count) as bigint) as cluster_weight_dup_sum, count(*) as n,
  case when g = '' and count(*) > 1 then 'customer <num> of segment <*> in nation <num> opened account' else min(normalized_content) end as cluster_template_guess from gr group by dataset, g),
 cl as (select *, printf('%s_C%07d', dataset, row_number() over (partition by dataset order by first)) as cluster_id from cc)"""


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster(dedup.normalized(dedup.exact(L.log_accounts(spark, sf_dir))))


@_query(f"""{ACCOUNTS} select dataset, ord, normalized_content, dup_count, cluster_id, cluster_size_unique, cluster_weight_dup_sum, cluster_template_guess from gr join cl using (dataset, g)""")
def cluster_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir).select("dataset", "ord", "normalized_content", F.col("dup_count").cast("long").alias("dup_count"), "cluster_id", F.col("cluster_size_unique").cast("long").alias("cluster_size_unique"), F.col("cluster_weight_dup_sum").cast("long").alias("cluster_weight_dup_sum"), "cluster_template_guess")


@_query(f"""{ACCOUNTS} select dataset, cluster_id, n as cluster_size_normalized_rows, cluster_size_unique, cluster_weight_dup_sum, cluster_template_guess,
 cast(case when cluster_weight_dup_sum >= 100000 and cluster_size_unique >= 100 then 3 when cluster_weight_dup_sum >= 1000 and cluster_size_unique >= 10 then 2 else 1 end as int) as recommended_keep_k_balanced from cl""")
def cluster_accounts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.cluster_summary(_accounts(spark, sf_dir))
    counts = [F.col(c).cast("long").alias(c) for c in ("cluster_size_normalized_rows", "cluster_size_unique", "cluster_weight_dup_sum")]
    return rows.select("dataset", "cluster_id", *counts, "cluster_template_guess", F.col("recommended_keep_k_balanced").cast("int").alias("recommended_keep_k_balanced"))


@_query(f"""{EVENTS} select case when dataset = 'click' then '*' else dataset end as scope, count(*) as logs, min(n) as bank_rows from ev
 join (select dataset as d, count(distinct event_template) as n from ev group by dataset union all select 'click', count(distinct (dataset, event_template)) from ev) on d = dataset and (dataset <> 'click' or n > 6) group by 1""")
def scope_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of `click` are served by all banks, as the one dataset that has none of its own kind is; others by their own."""
    rename = F.when(F.col("dataset") == "click", "Liberty").otherwise(F.col("dataset"))
    logs, banks = L.scoped(L.log_events(spark, sf_dir).withColumn("dataset", rename), _bank(spark, sf_dir))
    return logs.groupBy("scope").agg(F.count("*").alias("logs")).join(banks.groupBy("scope").agg(F.count("*").alias("bank_rows")), "scope").select("scope", "logs", "bank_rows")


@_query()
def cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.cluster(dedup.normalized(dedup.exact(L.log_urls(spark, sf_dir))))
    return rows.select("dataset", "ord", "cluster_id", "cluster_size_unique", "cluster_template_guess")


@_query(f"""{PROXY} select distinct dataset, cluster_id, cast(weight as bigint) as weight, n,
 case when weight >= 100000 and n >= 100 then 3 when weight >= 1000 and n >= 10 then 2 else 1 end as recommended,
 cast(least(case when n >= 100 or weight >= 100000 or n >= 5 then 3 when n >= 10 or weight >= 1000 or n >= 2 then 2 else 1 end, n) as int) as keep_k from cl""")
def keep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _proxy(spark, sf_dir).groupBy("dataset", "cluster_id").agg(F.max("cluster_weight_dup_sum").alias("weight"), F.count("*").alias("n"), F.max("cluster_size_unique").alias("u"))
    return rows.select("dataset", "cluster_id", "weight", "n", cluster.retention(F.col("weight"), F.col("u")).alias("recommended"), cluster.keep_k(F.col("weight"), F.col("u"), F.col("n")).alias("keep_k"))


# --- selection ----------------------------------------------------------------------------------------------------

_SETS = f"list_distinct({TOKENS % 'normalized_content'})"
_DISTANCE = "1.0 - len(list_intersect(r.toks, %s))::double / len(list_distinct(list_concat(r.toks, %s)))"


@_query(rf"""{PROXY}, k as (select *, least(case when n >= 5 or weight >= 100000 then 3 when n >= 2 or weight >= 1000 then 2 else 1 end, n) as keep, {_SETS} as toks, length(content) as len,
  (length(content), len({TOKENS % 'content'}), length(regexp_replace(content, '[A-Za-z0-9\s]', '', 'g')), len(regexp_extract_all(normalized_content, '<[a-z_]+>')), (contains(content, '/'))::int) as complexity from cl),
 r1 as (select *, row_number() over (partition by dataset, cluster_id order by dup_count desc, line_id) as a from k),
 r2 as (select *, row_number() over (partition by dataset, cluster_id order by complexity desc, dup_count desc, line_id) as b from r1 where a > 1 and keep >= 2),
 c3 as (select r.*, least({_DISTANCE % ('x.toks', 'x.toks')}, {_DISTANCE % ('y.toks', 'y.toks')}) as far, least(abs(r.len - x.len), abs(r.len - y.len)) as gap
   from r2 r join r1 x on x.a = 1 and x.dataset = r.dataset and x.cluster_id = r.cluster_id join r2 y on y.b = 1 and y.dataset = r.dataset and y.cluster_id = r.cluster_id where r.b > 1 and r.keep >= 3),
 r3 as (select *, row_number() over (partition by dataset, cluster_id order by far desc, gap desc, dup_count desc, line_id) as c from c3)
 select dataset, cluster_id, line_id, 1 as selected_rank, 'frequency_representative' as selection_reason from r1 where a = 1
 union all select dataset, cluster_id, line_id, 2, 'complex_sample' from r2 where b = 1 union all select dataset, cluster_id, line_id, 3, 'diverse_sample' from r3 where c = 1""")
def select_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.balanced(_proxy(spark, sf_dir)).select("dataset", "cluster_id", "line_id", "selected_rank", "selection_reason")


@_query(f"{PROXY} select dataset, cluster_id, line_id, content from (select *, row_number() over (partition by dataset, cluster_id order by dup_count desc, line_id) as r from cl) where r = 1")
def representative_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.representative_only(_proxy(spark, sf_dir)).select("dataset", "cluster_id", "line_id", "content")


@_query(f"{PROXY} select dataset, cluster_id, line_id, r as selected_rank from (select *, row_number() over (partition by dataset, cluster_id order by md5('7' || line_id), line_id) as r from cl) where r <= 3")
def hashed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.hashed_sample(_proxy(spark, sf_dir), F.lit(3), "7").select("dataset", "cluster_id", "line_id", F.col("selected_rank").cast("long").alias("selected_rank"))


@_query(f"""{PROXY}, s as (select * from (select *, row_number() over (partition by dataset, cluster_id order by md5('7' || line_id), line_id) as r from cl) where r <= 3),
 g as (select dataset, cluster_id, count(*) as k, sum(dup_count) as w from s group by dataset, cluster_id)
 select dataset, cast(sum(k) as bigint) as selected_log_count, count(*) as covered_cluster_count, cast(sum(w) as bigint) as selected_dup_weight_sum, cast(sum(k) as bigint) as selected_unique_content_sum,
 count(*) filter (k = 1) as clusters_with_1_sample, count(*) filter (k = 2) as clusters_with_2_sample, count(*) filter (k >= 3) as clusters_with_3plus_sample, max(k) as max_cluster_selected_count,
  any_value(total) as cluster_count, any_value(total) - count(*) as clusters_with_0_sample from g join (select dataset, count(distinct cluster_id) as total from cl group by dataset) using (dataset) group by dataset""")
def ablation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _proxy(spark, sf_dir)
    return select.coverage(select.hashed_sample(rows, F.lit(3), "7"), rows)


@_query()
def random_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _proxy(spark, sf_dir)
    baseline = {r["dataset"]: r["n"] for r in select.balanced(rows).groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    return select.random_global(rows, baseline, 13)


@_query()
def random_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _proxy(spark, sf_dir)
    return select.random_cluster(select.balanced(rows).drop("selected_rank", "selection_reason"), 13)


# --- retrieval and training records -------------------------------------------------------------------------------

_INDEX = f"""docs as (select dataset, ord, line_id, content, event_template, {TOKENS % 'lower(content)'} as toks from bank),
 post as (select dataset, ord, term, count(*) as tf from (select dataset, ord, unnest(toks) as term from docs) group by all),
 corpus as (select dataset, avg(len(toks)) as avgl, count(*) as n from docs group by dataset),
 idf as (select p.dataset, term, count(*) as df, ln(1.0 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from post p join corpus c using (dataset) group by p.dataset, term)"""
_SCORES = """sc as (select q.dataset, q.query, d.ord as key, d.line_id, d.content, d.event_template, round(coalesce(sum(i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(d.toks) / c.avgl))), 0.0), 9) as score
   from (select dataset, query, qc, unnest(list_distinct(qt)) as term from asked) q join docs d on d.dataset = q.dataset and {skip} join corpus c on c.dataset = q.dataset
   left join post p on p.dataset = d.dataset and p.ord = d.ord and p.term = q.term left join idf i on i.dataset = p.dataset and i.term = p.term
   group by q.dataset, q.query, d.ord, d.line_id, d.content, d.event_template, d.toks, c.avgl)"""


@_query(f"{BANK}, {_INDEX} select dataset, term, df, round(idf, 9) as idf from idf")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir).withColumn("key", F.col("ord"))
    return retrieve.stats(bank).withColumn("idf", F.round("idf", 9))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.log_events(spark, sf_dir).groupBy("dataset", "content").agg(F.min("ord").alias("query"))


@_query(f"""{BANK}, {_INDEX}, asked as (select dataset, content as qc, min(ord) as query, {TOKENS % 'lower(content)'} as qt from ev group by dataset, content),
 {_SCORES.format(skip='d.content <> q.qc')}
 select dataset, query, key, round(score, 6) as score, rank from (select *, row_number() over (partition by dataset, query order by score desc, cast(line_id as varchar), content) as rank from sc) where rank <= 5""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir).withColumns({"key": F.col("ord"), "line": F.col("line_id").cast("string")})
    best = retrieve.top_k(_asked(spark, sf_dir), bank, 5, ["line", "content"])
    return best.select("dataset", "query", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir).withColumn("normalized_content", T.normalize(F.col("content")))
    return bank.withColumns({"cluster_id": F.concat("dataset", F.lit(":"), F.length("content").cast("string")), "selected_rank": F.lit(1)})


_SAMPLES = f"""{BANK}, samples as (select *, {NORM} as normalized_content, dataset || ':' || length(content) as cluster_id from bank)"""
_LITE = rf""", cl as (select dataset, cluster_id, arg_max(normalized_content, (length(normalized_content), -line_id)) as t, max(length(content)) as l, count(*) as n from samples group by dataset, cluster_id),
 f as (select *, len(regexp_extract_all(t, '<([a-z_]+)>')) as m, len(list_distinct(regexp_extract_all(t, '<([a-z_]+)>'))) as kinds, len({TOKENS % 't'}) as toks, length(regexp_replace(t, '[A-Za-z0-9\s<>]', '', 'g')) as signs from cl),
 d as (select *, case when m = 0 then 'trivial' when m = 1 and toks <= 12 and signs <= 5 and l < 120 then 'single_var' when m >= 5 or toks >= 24 or signs >= 12 or l >= 180 then 'very_complex'
   when m >= 3 or kinds >= 2 or signs >= 8 or toks >= 16 or l >= 120 then 'complex' else 'medium' end as kind from f),
 lite as (select dataset, cluster_id, kind, cast(least(case kind when 'trivial' then 0 when 'very_complex' then 3 when 'complex' then 2 else 1 end, n) as int) as keep_count from d)"""


@_query(f"{_SAMPLES}{_LITE} select * from lite")
def lite_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fewshot.lite_decisions(_samples(spark, sf_dir))


@_query(f"""{_SAMPLES}{_LITE}, sized as (select lite.*, n from lite join cl using (dataset, cluster_id)) select coalesce(dataset, 'TOTAL') as dataset, cast(sum(n) as bigint) as retrieval_log_count, cast(sum(keep_count) as bigint) as query_sample_count,
 printf('%.6f', sum(keep_count) / sum(n)) as query_ratio, count(*) filter (kind = 'trivial') as trivial_cluster_count,
 count(*) filter (kind = 'single_var') as single_var_cluster_count, count(*) filter (kind = 'medium') as medium_cluster_count, count(*) filter (kind = 'complex') as complex_cluster_count,
 count(*) filter (kind = 'very_complex') as very_complex_cluster_count from sized group by rollup (dataset)""")
def lite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fewshot.lite_summary(_samples(spark, sf_dir))


@_query(f"""{_SAMPLES}{_LITE}, r as (select s.*, row_number() over (partition by s.dataset, s.cluster_id order by line_id, ord) as i from samples s)
 select r.dataset, r.cluster_id, r.line_id from r join lite using (dataset, cluster_id) where i <= keep_count""")
def lite_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fewshot.lite_queries(_samples(spark, sf_dir)).select("dataset", "cluster_id", "line_id")


_VARIANTS = """v as (select s || '-shot-only' as variant_name, 'shot-only' as variant_type, s as shot from range(4) t(s)
  union all select '0-' || m || '-shot', 'progressive', s from range(1, 4) a(m), range(4) b(s) where s <= m)"""
_JSON = "replace(replace(%s, '\\', '\\\\'), '\"', '\\\"')"


@_query(f"""{BANK}, {_INDEX}, asked as (select dataset, ord as query, content as qc, toks as qt from docs), {_SCORES.format(skip='d.ord <> q.query')},
 top as (select * from (select *, row_number() over (partition by dataset, query order by score desc, line_id, key) as rank from sc) where rank <= 3), {_VARIANTS},
 used as (select v.*, a.dataset, a.query, a.qc, list(struct_pack(c := t.content, e := t.event_template, l := t.line_id, s := t.score) order by t.rank desc) filter (t.rank is not null) as demos
   from asked a cross join v left join top t on t.dataset = a.dataset and t.query = a.query and t.rank <= v.shot group by all)
 select variant_name, variant_type, cast(shot as int) as shot, u.dataset, d.line_id, coalesce(array_to_string(list_transform(demos, lambda x: x.l), ','), '') as example_line_ids,
  '{{"instruction":"' || {_JSON % ("'" + T.INSTRUCTION + "'")} || '","input":"' || {_JSON % "coalesce('Examples:' || chr(10) || array_to_string(list_transform(demos, lambda x: '<content>' || x.c || chr(10) || '<template><START>' || x.e || '<END>' || chr(10) || chr(10)), '') || 'Query:' || chr(10), '') || '<content>' || qc || chr(10) || '<template>'"}
  || '","output":"' || {_JSON % "'<START>' || d.event_template || '<END>'"} || '"}}' as record
 from used u join docs d on d.dataset = u.dataset and d.ord = u.query""".replace("|| '\",\"output\"", "|| '\",\"output\""))
def fewshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    rows = fewshot.records(samples, samples, 3)
    # line feeds as the SQL side writes them
    record = F.replace("record", F.lit("\\n"), F.lit("\n"))
    return rows.select("variant_name", "variant_type", "shot", "dataset", "line_id", F.array_join(F.col("example_line_ids").cast("array<string>"), ",").alias("example_line_ids"), record.alias("record"))


@_query(f"""{BANK}, {_INDEX}, asked as (select dataset, ord as query, content as qc, toks as qt from docs), {_SCORES.format(skip='d.ord <> q.query')},
 top as (select *, dataset || ':' || length(content) as c, substr(md5(event_template), 1, 8) as e from (select *, row_number() over (partition by dataset, query order by score desc, line_id, key) as rank from sc) where rank <= 3), {_VARIANTS},
 used as (select v.*, a.dataset, a.query, string_agg(t.c, ',' order by t.rank desc) as cs, string_agg(t.e, ',' order by t.rank desc) as es from asked a cross join v left join top t on t.dataset = a.dataset and t.query = a.query and t.rank <= v.shot group by all)
 select variant_name, cast(shot as int) as shot, u.dataset, d.line_id, substr(md5(d.event_template), 1, 8) as event_id, d.dataset || ':' || length(d.content) as cluster_id, coalesce(es, '') as example_event_ids, coalesce(cs, '') as example_cluster_ids
 from used u join docs d on d.dataset = u.dataset and d.ord = u.query""")
def fewshot_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    lists = [F.array_join(c, ",").alias(c) for c in ("example_event_ids", "example_cluster_ids")]
    return fewshot.records(samples, samples, 3).select("variant_name", "shot", "dataset", "line_id", "event_id", "cluster_id", *lists)


@_query(f"""{_SAMPLES}{_LITE}, {_VARIANTS}, g as (select variant_name, variant_type, count(*) as shots, string_agg(shot, ',' order by shot) as shot_numbers from v group by 1, 2),
 n as (select dataset, count(*) as n from samples group by dataset), q as (select dataset, cast(sum(keep_count) as bigint) as q from lite group by dataset)
 select variant_name, variant_type, shot_numbers, dataset, n as retrieval_log_count, q as query_log_count, q * shots as jsonl_record_count, 'content' as retrieval_field, 'chat' as output_format, 'lite' as query_mode from g cross join n join q using (dataset)""")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    return fewshot.experiment_summary(fewshot.lite_queries(samples), samples, 3, form="chat", mode="lite")


@_query(f"""{BANK}, {_VARIANTS} select variant_name, variant_type, count(*) as n from bank cross join v group by 1, 2""")
def variant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _bank(spark, sf_dir).agg(F.count("*").alias("c"))
    v = fewshot.variants(spark, 3).groupBy("variant_name", "variant_type").agg(F.count("*").alias("s"))
    return v.join(n).select("variant_name", "variant_type", (F.col("s") * F.col("c")).alias("n"))  # one row on the right


@_query()
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    return fewshot.records(fewshot.lite_queries(samples), samples, 2, "chat", "normalized_content")


# --- templates ----------------------------------------------------------------------------------------------------

_PARTS = "list_filter(list_transform(string_split(event_template, '<*>'), lambda x: trim(x)), lambda x: x <> '')"


@_query(rf"""{BANK}, t as (select distinct event_template from bank), p as (select event_template, {_PARTS} as parts from t)
 select event_template, array_to_string(parts, '|') as parts, coalesce(list_sum(list_transform(parts, lambda x: length(x))), 0)::int as chars,
 coalesce(list_sum(list_transform(parts, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+')))), 0)::int as words, ((length(event_template) - length(replace(event_template, '<*>', ''))) / 3)::int as wildcards,
 not starts_with(event_template, '<*>') as anchored_start, not ends_with(event_template, '<*>') as anchored_end from p""")
def pattern_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _bank(spark, sf_dir).select("event_template").distinct().withColumn("p", P.pattern(F.col("event_template")))
    return p.select("event_template", F.array_join("p.parts", "|").alias("parts"), *[f"p.{c}" for c in ("chars", "words", "wildcards", "anchored_start", "anchored_end")])


@_query("with t as (select distinct event_template from (" + L.LOG_EVENTS_SQL + ")) select event_template, substr(md5(event_template), 1, 8) as event_id from t")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.log_events(spark, sf_dir).select("event_template").distinct()
    return t.withColumn("event_id", T.event_id(F.col("event_template")))


#: A walk over the parts: {{pos, errors}} after each; pos is where the next search starts, from 1.
_WALK = """list_reduce(list_prepend({'p': '', 'pos': 1, 'err': 0, 'first': 0}, list_transform(parts, lambda x: {'p': x, 'pos': 0, 'err': 0, 'first': 0})),
  lambda a, x: case when strpos(substr(content, a.pos), x.p) > 0 then {'p': x.p, 'pos': a.pos + strpos(substr(content, a.pos), x.p) - 1 + length(x.p), 'err': a.err, 'first': case when a.first = 0 then a.pos + strpos(substr(content, a.pos), x.p) - 1 else a.first end}
  else {'p': x.p, 'pos': a.pos, 'err': a.err + 1, 'first': a.first} end)"""
_LOGS = "logs as (select dataset, content, min(ord) as ord from ev group by dataset, content)"


@_query(f"""{BANK}, {_LOGS}, pairs as (select l.dataset, l.ord, l.content, b.event_template, b.ord as bank_ord, {_PARTS} as parts from logs l join bank b on b.dataset = l.dataset),
 w as (select *, {_WALK} as w from pairs) select dataset, ord, bank_ord, (w.err = 0) as valid, cast(w.err as int) as n_errors from w""")
def validate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _asked(spark, sf_dir).withColumnRenamed("query", "ord")
    bank = _bank(spark, sf_dir).select("dataset", F.col("ord").alias("bank_ord"), "event_template")
    v = logs.join(bank, "dataset").withColumn("v", P.validate(F.col("content"), F.col("event_template")))
    return v.select("dataset", "ord", "bank_ord", "v.valid", F.size("v.errors").alias("n_errors"))


_MATCHED = f"""pairs as (select l.dataset, l.ord, l.content, b.event_template, b.ord as bank_ord, {_PARTS} as parts, ((length(event_template) - length(replace(event_template, '<*>', ''))) / 3)::int as wild
   from logs l join bank b on b.dataset = l.dataset),
 w as (select *, {_WALK} as w, coalesce(list_sum(list_transform(parts, lambda x: length(x))), 0)::int as chars, coalesce(list_sum(list_transform(parts, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+')))), 0)::int as words,
   not starts_with(event_template, '<*>') as a0, not ends_with(event_template, '<*>') as a1 from pairs),
 good as (select *, chars / length(content) as cover from w where wild > 0 and chars >= 12 and words >= 2 and w.err = 0 and (not a0 or w.first = 1) and (not a1 or w.pos = length(content) + 1)
   and chars / length(content) >= case when a0 or a1 then 0.20 else 0.35 end),
 matched as (select dataset, content, min(ord) as ord, arg_max(event_template, (chars, words, floor(cover * 1000)::int, a0::int, a1::int, -wild, bank_ord)) as template from good group by dataset, content)"""


@_query(f"{BANK}, {_LOGS}, {_MATCHED} select dataset, content, template from matched")
def pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.match_patterns(L.log_events(spark, sf_dir), _bank(spark, sf_dir))


# --- parsing ------------------------------------------------------------------------------------------------------

#: The bank of the parsing queries knows some templates only, so that every source of an answer occurs.
_SMALL = f"""{EVENTS}, bank as (select dataset, event_template, min(ord) as ord, arg_min(content, ord) as content from ev where ord % 6 not in (1, 2) group by dataset, event_template)"""
_PARSED = f"""{_LOGS}, {_MATCHED}, sig as (select dataset, content, {SIGN} as s from logs),
 signed as (select l.dataset, l.content, arg_max(b.event_template, b.ord) as template from sig l join (select dataset, event_template, ord, {SIGN} as s from bank) b on b.dataset = l.dataset and b.s = l.s where l.s <> l.content group by 1, 2),
 answers as (select l.dataset, l.content, coalesce(b.event_template, g.template, m.template, s.s) as predicted_template,
   case when b.event_template is not null then 'exact_cache' when g.template is not null then 'signature_cache' when m.template is not null then 'pattern_cache' else 'llm' end as decision_source
   from logs l join sig s using (dataset, content) left join bank b using (dataset, content) left join signed g using (dataset, content) left join matched m using (dataset, content)),
 parsed as (select ev.dataset, ev.ord, ev.line_id, ev.content, ev.event_template, predicted_template, decision_source from ev join answers using (dataset, content))"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = L.log_events(spark, sf_dir)
    return parse.parse_sets(logs, L.bank(logs.where("ord % 6 not in (1, 2)")))


@_query(f"{_SMALL}, {_PARSED} select dataset, ord, predicted_template, decision_source from parsed")
def parse_set_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("dataset", "ord", "predicted_template", "decision_source")


@_query(f"""{_SMALL}, {_PARSED} select dataset, count(*) as total_logs, count(*) filter (decision_source like '%cache') as cache_hits, count(*) filter (decision_source = 'exact_cache') as exact_hits,
 count(*) filter (decision_source = 'signature_cache') as signature_hits, count(*) filter (decision_source = 'pattern_cache') as pattern_hits, count(*) filter (decision_source in ('llm', 'failed')) as llm_calls,
 count(*) filter (decision_source = 'llm') as llm_valid, count(*) filter (decision_source = 'failed') as failed from parsed group by dataset""")
def parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.parse_stats(_parsed(spark, sf_dir))


@_query(f"""{_SMALL}, {_PARSED}, s as (select dataset, count(*) as n, count(*) filter (decision_source like '%cache') / count(*) as rate from parsed group by dataset)
 select count(*) as dataset_count, cast(sum(n) as bigint) as total_logs, round(avg(rate), 9) as macro_average, round(sum(rate * n) / sum(n), 9) as weighted_average from s""")
def weighted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.parse_stats(_parsed(spark, sf_dir)).withColumn("rate", F.col("cache_hits") / F.col("total_logs"))
    return metrics.overall(stats, "rate").withColumns({c: F.round(c, 9) for c in ("macro_average", "weighted_average")})


@_query(f"""{_SMALL}, {_PARSED} select dataset, cast(line_id as varchar) as LineId, content as Content, substr(md5(predicted_template), 1, 8) as EventId, predicted_template as EventTemplate from parsed""")
def export_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.export_predictions(_parsed(spark, sf_dir))


#: The bank of _SMALL with line numbers, for retrieval.
_SMALL_LINES = _SMALL.replace("arg_min(content, ord) as content", "arg_min(content, ord) as content, arg_min(line_id, ord) as line_id")


@_query(f"""{_SMALL_LINES}, {_PARSED}, {_INDEX}, asked as (select ev.dataset, ev.content as qc, min(ev.ord) as query, {TOKENS % 'lower(ev.content)'} as qt from ev join answers a on a.dataset = ev.dataset and a.content = ev.content
  where a.decision_source = 'llm' group by ev.dataset, ev.content), {_SCORES.format(skip='d.content <> q.qc')},
 top as (select * from (select *, row_number() over (partition by dataset, query order by score desc, cast(line_id as varchar), content) as rank from sc) where rank <= 3),
 demos as (select dataset, query, count(*) as n, string_agg(cast(line_id as varchar), '|' order by rank) as lines, arg_min(event_template, rank) as event_template from top group by dataset, query),
 walked as (select *, {_WALK} as w from (select a.dataset, a.qc as content, d.n, d.lines, d.event_template, {_PARTS} as parts from asked a join demos d using (dataset, query))),
 told as (select dataset, content, n, lines, w.err = 0 as good, event_template from walked)
 select p.dataset, p.ord, cast(p.line_id as varchar) as line_id, case when t.good then t.event_template else p.predicted_template end as predicted_template, p.decision_source, p.decision_source like '%cache' as cache_hit,
  cast(coalesce(t.n, 0) as int) as num_demos, cast(case when p.decision_source <> 'llm' then 0 when t.good then 1 else 2 end as int) as model_attempts, coalesce(t.lines, '') as demo_line_ids,
  case when p.decision_source <> 'llm' then '' else '<START>' || (case when t.good then t.event_template else p.predicted_template end) || '<END>' end as raw_response, p.event_template as ground_truth_template
 from parsed p left join told t on t.dataset = p.dataset and t.content = p.content and p.decision_source = 'llm'""")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demonstrations reach the generator, which answers with the best one's template first and the signature after it."""
    logs = L.log_events(spark, sf_dir)
    rows = parse.predictions(logs, L.bank(logs.where("ord % 6 not in (1, 2)")), parse.nearest_generator, 3, 2)
    return rows.select("dataset", "ord", "line_id", "predicted_template", "decision_source", "cache_hit", "num_demos", "model_attempts", "demo_line_ids", "raw_response", "ground_truth_template")


@_query()
def parse_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_ordered(L.log_events(spark, sf_dir)).select("dataset", "ord", "predicted_template", "decision_source")


#: One sequence row for each user and dataset: its logs in order.
@_query(f"""{_SMALL.replace("from events)", "from events)")}, {_PARSED}, owner as (select event_id, user_id from events)
 select p.dataset, user_id as ord, string_agg(predicted_template, ' ;-; ' order by p.ord) as "Template" from parsed p join owner o on o.event_id = p.ord group by 1, 2""")
def sequence_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = L.log_events(spark, sf_dir)
    users = L.table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), "user_id")
    logs_by = logs.join(users, "ord").groupBy("dataset", "user_id").agg(F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("x"))
    rows = logs_by.select("dataset", F.col("user_id").cast("long").alias("ord"), F.array_join(F.transform("x", lambda v: v["content"]), " ;-; ").alias("content"))
    return parse.parse_sequences(rows, L.bank(logs.where("ord % 6 not in (1, 2)"))).select("dataset", "ord", "Template")


# --- accuracy -----------------------------------------------------------------------------------------------------

_PRED = "case when ord % 6 = 0 and ord % 5 = 0 then '' when ord % 6 in (3, 5) then %s when ord % 6 = 1 and ord % 4 = 0 then 'other' else event_template end".replace("%s", SIGN)
_ALIGNED = f"""{EVENTS}, al as (select dataset, event_template as t, {_PRED} as p from ev), pairs as (select dataset, t, p, count(*) as n from al group by all)"""
_GROUPING = """pn as (select dataset, p, sum(n) as pn from pairs group by all), tn as (select dataset, t, count(*) as k, sum(n) as n, min(p) as p from pairs group by all),
 ok as (select tn.dataset, tn.n, (k = 1 and tn.n = pn)::int as ok from tn join pn using (dataset, p)),
 ga as (select ok.dataset, sum(ok * n) / sum(n) as "GA", sum(ok) as c, count(*) as nt from ok group by ok.dataset), np as (select dataset, count(*) as np from pn group by dataset),
 grp as (select ga.dataset, "GA", case when c = 0 then 0.0 else 2 * (c / np) * (c / nt) / (c / np + c / nt) end as "FGA" from ga join np using (dataset))"""
_TA = """per as (select dataset, p, (min(t) = p and max(t) = p)::int as ok from pairs group by dataset, p),
 ta as (select dataset, sum(ok) as c, count(*) as ni from per group by dataset), tt as (select dataset, count(distinct t) as ng from pairs group by dataset),
 tl as (select dataset, ni as identified_templates, ng as ground_templates, c / ni as "PTA", c / ng as "RTA", case when c = 0 then 0.0 else 2 * (c / ni) * (c / ng) / (c / ni + c / ng) end as "FTA" from ta join tt using (dataset))"""
_PA = """pa as (select dataset, avg((t = p)::int) as "PA" from al group by dataset)"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = L.log_events(spark, sf_dir)
    o = F.col("ord")
    guess = F.when((o % 6 == 0) & (o % 5 == 0), F.lit(None)).when((o % 6).isin(3, 5), T.signature(F.col("content"))).when((o % 6 == 1) & (o % 4 == 0), "other").otherwise(F.col("event_template"))
    return metrics.align(logs, logs.select("dataset", "line_id", guess.alias("predicted_template")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])


@_query(f'{_ALIGNED}, {_GROUPING} select dataset, round("GA", 9) as "GA", round("FGA", 9) as "FGA" from grp')
def eval_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.grouping(_aligned(spark, sf_dir)))


@_query(f'{_ALIGNED}, {_PA} select dataset, round("PA", 9) as "PA" from pa')
def eval_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.parsing(_aligned(spark, sf_dir)))


@_query(f'{_ALIGNED}, {_TA} select dataset, identified_templates, ground_templates, round("PTA", 9) as "PTA", round("RTA", 9) as "RTA", round("FTA", 9) as "FTA" from tl')
def eval_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.template_level(_aligned(spark, sf_dir)))


_ALL = f"{_ALIGNED}, {_GROUPING}, {_PA}, {_TA}"


@_query(f"""{_ALL} select dataset, identified_templates, ground_templates, round("GA", 9) as "GA", round("PA", 9) as "PA", round("FGA", 9) as "FGA", round("PTA", 9) as "PTA", round("RTA", 9) as "RTA", round("FTA", 9) as "FTA"
 from grp join pa using (dataset) join tl using (dataset)""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.evaluate(_aligned(spark, sf_dir)))


@_query(f"""{_ALL}, s as (select dataset, round("GA" * 100, 1) as "GA", round("PA" * 100, 1) as "PA", round("FTA" * 100, 1) as "FTA" from grp join pa using (dataset) join tl using (dataset))
 select dataset, "GA", "PA", "FTA" from s union all select 'Average', round(avg("GA"), 3), round(avg("PA"), 3), round(avg("FTA"), 3) from s""")
def eval_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.evaluate(_aligned(spark, sf_dir)).select("dataset", *[F.round(F.col(c) * 100, 1).alias(c) for c in ("GA", "PA", "FTA")])
    return metrics.with_average(s)
