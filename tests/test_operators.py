import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.operators import cluster, dedup, fewshot, metrics, retrieve, select
from logweave.plans import parse
from logweave.sources import logs as L

VIEW = "dataset string, ord bigint, line_id bigint, content string, event_template string"


def logs(spark, rows):
    return spark.createDataFrame([("d", i, i + 1, c, t) for i, (c, t) in enumerate(rows)], VIEW)


def test_dedup_keeps_weight_and_order(spark):
    df = logs(spark, [("a 1", None), ("b", None), ("a 2", None), ("a 1", None), ("a 2", None), ("a 2", None)])
    rows = {r["normalized_content"]: r for r in dedup.normalized(dedup.exact(df)).collect()}
    assert rows["a <num>"]["dup_count"] == 5 and rows["a <num>"]["content"] == "a 2" and rows["a <num>"]["ord"] == 0
    assert rows["a <num>"]["normalized_unique_content_count"] == 2
    assert sum(r["dup_count"] for r in rows.values()) == 6


def test_split_removes_every_repeat(spark):
    full, train = logs(spark, [("a", None), ("b", None), ("a", None)]), logs(spark, [("a", None)])
    assert [r["content"] for r in dedup.test_split(full, train).collect()] == ["b"]
    s = dedup.split_summary(full, train).first()
    assert (s["full_count"], s["unique_train_contents"], s["removed_count"], s["test_count"]) == (3, 1, 2, 1)


def naive_clusters(rows, threshold=0.82):
    """One sequential pass over all rows, as the definition says; nothing of the code under test is used."""
    mark = lambda x: x.startswith("<") and x.endswith(">") and x[1:-1].replace("_", "a").isalpha()

    def agree(toks, template):
        told = [(a, b) for a, b in zip(toks, template, strict=True) if b != "<*>"]
        return sum(a == b or mark(a) or mark(b) for a, b in told) / len(told) if told else 1.0

    clusters = []
    out = []
    for toks in rows:
        stable = [t for t in toks if not mark(t)]
        key = (len(toks), stable[:2], stable[-1:])
        best, score = None, -1
        for k, (key2, template) in enumerate(clusters):
            if key2 == key and (s := agree(toks, template)) > score:
                best, score = k, s
        if best is None or score < threshold:
            clusters.append((key, list(toks)))
            best = len(clusters) - 1
        else:
            t = clusters[best][1]
            for i, x in enumerate(toks):
                if t[i] != x and not (mark(t[i]) and mark(x)):
                    t[i] = "<*>"
        out.append(best)
    return out


def test_cluster_equals_one_pass(spark):
    r = random.Random(4)
    words = [f"open file {r.choice('abcd')} {r.choice('xy')} by {r.choice(['root', 'me'])} in {r.choice('pqrstu')} z" for _ in range(80)]
    rows = dedup.normalized(dedup.exact(logs(spark, [(w, None) for w in words])))
    got = cluster.cluster(rows).orderBy("ord").collect()
    expected = naive_clusters([x["content"].split() for x in got])
    assert [x["cluster_id"] for x in got] == [f"d_C{k + 1:07d}" for k in expected]
    assert sum(x["dup_count"] for x in got) == 80


def test_empty_tables(spark):
    none = logs(spark, [("a", "b")]).limit(0)
    rows = dedup.normalized(dedup.exact(none))
    assert rows.count() == 0 and dedup.test_split(none, none).count() == 0
    clustered = cluster.cluster(rows)
    assert clustered.count() == 0 and cluster.cluster_summary(clustered).count() == 0
    assert select.balanced(clustered).count() == 0 and L.bank(none).count() == 0


def test_scopes_and_their_banks(spark):
    rows = [(d, i, i, f"{d} {i}", "t") for i, d in enumerate(["HDFS", "Spark", "Spark"])]
    banks = spark.createDataFrame(rows, VIEW)
    asked = spark.createDataFrame([(d, 0, 0, "x", None) for d in ("Liberty", "HDFS_v1", "Spark")], VIEW)
    served, held = L.scoped(asked, banks)
    assert {(r["dataset"], r["scope"]) for r in served.collect()} == {("Liberty", "*"), ("HDFS_v1", "HDFS"), ("Spark", "Spark")}
    assert Counter(r["scope"] for r in held.collect()) == {"*": 3, "HDFS": 1, "Spark": 2}
    with pytest.raises(Exception, match="no support bank for Mac"):
        L.scoped(asked.withColumn("dataset", F.lit("Mac")), banks)[0].collect()


def test_selection(spark):
    rows = [("d", i, i + 1, f"log {'x' * i}", f"log {'x' * i}", n, "c", 3, 10, 1) for i, n in enumerate([2, 9, 1])]
    df = spark.createDataFrame(rows, "dataset string, ord bigint, line_id bigint, content string, normalized_content string, dup_count bigint, cluster_id string, cluster_size_unique bigint, cluster_weight_dup_sum bigint, normalized_unique_content_count int")
    got = {r["selected_rank"]: r["line_id"] for r in select.balanced(df).collect()}
    assert got == {1: 2, 2: 3}
    assert [r["selected_rank"] for r in select.in_order(select.balanced(df)).collect()] == [1, 2]
    assert select.representative_only(df).first()["line_id"] == 2
    picked = [r["line_id"] for r in select.random_global(df, {"d": 2}, 5).orderBy("selected_rank").collect()]
    assert picked == [i + 1 for i in random.Random(5).sample(range(3), 2)]
    with pytest.raises(ValueError):
        select.random_global(df, {"d": 9}, 5)
    assert select.coverage(select.balanced(df)).first()["clusters_with_2_sample"] == 1


def test_bm25(spark):
    texts = ["open file a", "open socket", "close file a now", "zzz", "open file a"]
    bank = logs(spark, [(t, t) for t in texts]).withColumn("key", F.col("ord"))
    docs = [t.split() for t in texts]
    avg, df = sum(map(len, docs)) / len(docs), Counter(w for d in docs for w in set(d))

    def score(q, d):
        return sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in set(q) if w in d)

    got = retrieve.top_k(bank.withColumn("query", F.col("ord")), bank, 3, ["line_id", "ord"]).collect()
    for q, text in enumerate(texts):
        ranked = sorted((-round(score(docs[q], d), 9), k) for k, d in enumerate(docs) if texts[k] != text)[:3]
        mine = sorted((r["rank"], r["key"], r["score"]) for r in got if r["query"] == q)
        assert [k for _, k, _ in mine] == [k for _, k in ranked]
        assert all(abs(s + x) < 1e-6 for (_, _, s), (x, _) in zip(mine, ranked, strict=True))


def test_variants(spark):
    rows = fewshot.variants(spark, 2).collect()
    assert Counter(r["variant_name"] for r in rows) == {"0-shot-only": 1, "1-shot-only": 1, "2-shot-only": 1, "0-1-shot": 2, "0-2-shot": 3}


def test_metrics(spark):
    rows = [("d", "a", "a"), ("d", "a", "a"), ("d", "b", ""), ("d", "c", "x"), ("d", "c", "y")]
    r = metrics.evaluate(spark.createDataFrame(rows, "dataset string, truth string, pred string")).first()
    assert r["GA"] == 3 / 5 and r["PA"] == 2 / 5 and r["PTA"] == 1 / 4 and r["RTA"] == 1 / 3
    assert abs(r["FGA"] - 2 * (2 / 4) * (2 / 3) / (2 / 4 + 2 / 3)) < 1e-12
    assert metrics.with_average(metrics.parsing(spark.createDataFrame(rows, "dataset string, truth string, pred string"))).count() == 2


def test_ordered_parse_learns(spark):
    df = logs(spark, [("user 1 logged in from host 22", None), ("user 2 logged in from host 23", None), ("user 2 logged in from host 23", None), ("user <*> logged in from host a now", None)])
    got = [r["decision_source"] for r in parse.parse_ordered(df).orderBy("ord").collect()]
    assert got[:3] == ["llm", "signature_cache", "exact_cache"]


def test_small_caches_forget():
    caches = parse.TemplateCaches(exact=1, signature=1, patterns=1)
    for log in ("a1b2c value", "d3e4f other"):
        caches.learn(log, "<*> " + log.split()[1], "<*> " + log.split()[1])
    assert list(caches.exact) == ["d3e4f other"] and list(caches.signed) == ["<*> other"]


def test_set_mode_sources(spark):
    bank = logs(spark, [("user 1 logged in from host 22", "user <*> logged in from host <*>")])
    asked = logs(spark, [("user 1 logged in from host 22", None), ("user 5 logged in from host 9", None), ("user bob logged in from host x", None), ("other text", None)])
    got = {r["ord"]: (r["decision_source"], r["predicted_template"]) for r in parse.parse_sets(asked, bank).collect()}
    assert [got[i][0] for i in range(4)] == ["exact_cache", "signature_cache", "pattern_cache", "llm"]
    assert got[3][1] == "other text"


def test_sequences(spark):
    bank = logs(spark, [("user 1 logged in from host 22", "user <*> logged in from host <*>")])
    rows = spark.createDataFrame([("d", 0, "user 4 logged in from host 5 ;-; ping"), ("d", 1, " ")], "dataset string, ord bigint, content string")
    got = {r["ord"]: r["Template"] for r in parse.parse_sequences(rows, bank).collect()}
    assert got == {0: "user <*> logged in from host <*> ;-; ping", 1: ""}


def test_long_sequences(spark):
    bank = logs(spark, [("user 1 logged in from host 22", "user <*> logged in from host <*>")])
    many = 1_000_001
    rows = spark.createDataFrame([("d", 0, "ping ;-; " * many + "pong"), ("d", 1, "user 4 logged in from host 5"), ("d", 10**14, "ping")], "dataset string, ord bigint, content string")
    got = {r["ord"]: r["Template"] for r in parse.parse_sequences(rows, bank).collect()}
    assert got[0] == "ping ;-; " * many + "pong"
    assert {k: v for k, v in got.items() if k} == {1: "user <*> logged in from host <*>", 10**14: "ping"}


def test_csv_round_trip(spark, tmp_path):
    for name in ("A", "B"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}_structured.csv").write_text('LineId,Content,EventTemplate,Level\n1,"a ""x"", b",t,\nx,c,,INFO\n')
    df = L.as_view(L.read_structured(spark, str(tmp_path))).orderBy("dataset", "ord").collect()
    assert [r["content"] for r in df] == ['a "x", b', "c"] * 2 and df[1]["line_id"] == 2**63 - 1 and df[1]["event_template"] == ""
    assert df[1]["extra"] == {"Level": "INFO"}
    with pytest.raises(ValueError):
        L.dataset_names(spark, str(tmp_path), ["C"])
    with pytest.raises(ValueError):
        L.dataset_names(spark, str(tmp_path), expected=14)
    assert L.names_from(" a, b,,a") == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    from logweave.streaming.parse_stream import parse_stream

    rows = logs(spark, [(f"user {i % 3} logged in from host {i}", None) for i in range(12)])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = parse_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["ord"], r["predicted_template"], r["decision_source"]) for r in spark.table("parsed").collect()}
    want = {(r["ord"], r["predicted_template"], r["decision_source"]) for r in parse.parse_ordered(rows).collect()}
    assert got == want and len(got) == 12


def test_filtered_metrics(spark):
    rows = [("d", "a", "a"), ("d", "a", "a"), ("d", "b", ""), ("d", "c", "x"), ("d", "c", "y")]
    aligned = spark.createDataFrame(rows, "dataset string, truth string, pred string")
    r = metrics.filtered(aligned, spark.createDataFrame([("d", "a"), ("d", "c")], "dataset string, truth string")).first()
    assert (r["GA"], r["PA"], r["PTA"], r["RTA"]) == (2 / 4, 2 / 4, 1 / 3, 1 / 2)


def test_python_generator(spark):
    made = parse.python_generator(lambda: lambda prompts: [f"<START>{p.split('<content>')[-1].split()[0]} <*><END>" for p in prompts])
    got = parse.parse_sets(logs(spark, [("alpha 1", None)]), logs(spark, [("zzz", "zzz")]), made).first()
    assert (got["predicted_template"], got["decision_source"]) == ("alpha <*>", "llm")


def test_loaders(spark, tmp_path):
    rows = logs(spark, [(f"c{i}", f"t{i}") for i in range(30)])
    train, held = L.eval_split(rows, 0.3, 4)
    assert train.count() + held.count() == 30 and 0 < held.count() < 30
    none = F.expr("cast(array() as array<struct<content:string,template:string>>)")
    L.write_jsonl(rows, T.instruction_record(F.col("content"), F.col("event_template"), none), str(tmp_path / "j"))
    back = L.read_jsonl(spark, str(tmp_path / "j"), 5)
    assert back.count() == 5
    q, a = T.prompt_and_answer(F.struct("*"), "instruction")
    row = back.select(q.alias("q"), a.alias("a")).first()
    assert row["q"].startswith(T.INSTRUCTION) and row["a"].startswith("<START>t")
    assert L.ints_from("1, 2") == [1, 2]


def test_predictions(spark):
    bank = spark.createDataFrame([("a", 1, 2, "disk nine is full", "disk <*> is full"), ("a", 2, 3, "link up now", "")], VIEW)
    logs = spark.createDataFrame(
        [("a", 10, 11, "disk nine is full", None), ("a", 11, 12, "disk ten is full", "disk <*> is full"), ("a", 12, 13, "disk ten is full", None), ("a", 13, 14, "fan 7 slow", None), ("a", 14, 15, None, None), ("b", 1, 2, "no bank 5", None)], VIEW
    )
    rows = {(r["dataset"], r["ord"]): r for r in parse.predictions(logs, bank, parse.nearest_generator, 3, 2).collect()}
    assert len(rows) == 6
    assert rows["a", 10]["decision_source"] == "exact_cache" and rows["a", 10]["model_attempts"] == 0 and rows["a", 10]["exact_cache_hit"]
    one = rows["a", 11]
    # the bank row without a template is retrieved but not shown
    assert (one["predicted_template"], one["decision_source"], one["num_demos"], one["demo_line_ids"], one["model_attempts"]) == ("disk <*> is full", "llm", 1, "2", 1)
    assert float(one["demo_scores"]) > 0 and one["raw_response"] == "<START>disk <*> is full<END>" and rows["a", 12]["model_attempts"] == 1
    assert (rows["a", 13]["predicted_template"], rows["a", 13]["model_attempts"]) == ("fan <*> slow", 2)
    assert (rows["a", 14]["predicted_template"], rows["a", 14]["decision_source"]) == ("", "failed")
    assert (rows["b", 1]["num_demos"], rows["b", 1]["predicted_template"]) == (0, "no bank <*>")
    assert parse.predictions(logs.limit(0), bank).count() == 0
    assert {r["ord"]: r["decision_source"] for r in parse.parse_sets(logs, bank).collect()}[14] == "failed"
    assert parse.predictions(logs, bank, shots=0).where("num_demos > 0").count() == 0


def test_predictions_chat(spark):
    def make():
        def model(chats):
            assert all(c[0]["role"] == "system" and c[-1]["role"] == "user" for c in chats)
            return ["<START>" + ("disk <*> is full" if "Examples:" in c[-1]["content"] else "none") + "<END>" for c in chats]

        return model

    bank = spark.createDataFrame([("a", 1, 2, "disk nine is full", "disk <*> is full")], VIEW)
    logs = spark.createDataFrame([("a", 5, 6, "disk ten is full", None), ("b", 6, 7, "disk ten is full", None)], VIEW)
    rows = {r["dataset"]: r for r in parse.predictions(logs, bank, parse.python_generator(make, chat=True), 2, 2).collect()}
    assert (rows["a"]["predicted_template"], rows["a"]["model_attempts"]) == ("disk <*> is full", 1)
    assert (rows["b"]["decision_source"], rows["b"]["model_attempts"], rows["b"]["raw_response"]) == ("failed", 2, "<START>none<END>")


def test_coverage_of_all_clusters(spark):
    rows = spark.createDataFrame([("a", "c1", 2, 1), ("a", "c2", 1, 1), ("b", "c3", 1, 1)], "dataset string, cluster_id string, dup_count int, normalized_unique_content_count int")
    found = {r["dataset"]: r for r in select.coverage(rows.where("cluster_id = 'c1'"), rows).collect()}
    assert (found["a"]["cluster_count"], found["a"]["clusters_with_0_sample"], found["a"]["selected_dup_weight_sum"]) == (2, 1, 2)
    assert (found["b"]["covered_cluster_count"], found["b"]["clusters_with_0_sample"], found["b"]["selected_log_count"]) == (0, 1, 0)


def test_generate_all(spark, tmp_path):
    rows = [("a", i, i, f"job {i} of node {w} done", "job <*> of node <*> done", f"job <num> of node {w} done", f"c{i % 2}", 1) for i, w in enumerate(("x", "y", "z"))]
    samples = spark.createDataFrame(rows, VIEW + ", normalized_content string, cluster_id string, selected_rank int")
    fewshot.generate_all(samples, str(tmp_path), 1, mode="lite")
    kept = fewshot.lite_queries(samples).count()
    assert kept
    lines = spark.read.text(str(tmp_path / "train"))
    told = spark.read.json(str(tmp_path / "metadata"))
    shots = {"0-shot-only": 1, "1-shot-only": 1, "0-1-shot": 2}
    for table in (lines.groupBy("variant_name").count(), told.groupBy("variant_name").count()):
        assert {r["variant_name"]: r["count"] for r in table.collect()} == {v: n * kept for v, n in shots.items()}
    shown = told.where("shot = 1").first()
    assert len(shown["example_line_ids"]) == len(shown["example_event_ids"]) == len(shown["example_cluster_ids"]) == 1 and shown["event_id"]
    summary = {r["variant_name"]: r for r in spark.read.csv(str(tmp_path / "experiment_summary"), header=True).collect()}
    assert summary["0-1-shot"]["shot_numbers"] == "0,1" and int(summary["0-1-shot"]["jsonl_record_count"]) == 2 * kept
    lite = {r["dataset"]: r for r in spark.read.csv(str(tmp_path / "lite_query_summary"), header=True).collect()}
    assert lite["TOTAL"]["query_ratio"] == f"{kept / 3:.6f}"
    with pytest.raises(ValueError):
        fewshot.generate_all(samples, str(tmp_path), mode="half")
