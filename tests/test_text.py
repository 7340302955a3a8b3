from pyspark.sql import functions as F

from logweave.functions import templates as P
from logweave.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_normalize(spark):
    cases = {
        "proxy.example.org:5070 close, 0 bytes sent": "<id> close, <num> bytes sent",
        "  open http://a.b/c?d=1  now ": "open <url> now",
        "mail from x@y.org at 10:20:30": "mail from <email> at <ip>",
        "peer 10.1.2.3:80 is up, id 0xFF": "peer <ip> is up, id <hex>",
        "read /data/a/b and /etc/ssh failed": "read <path> and /etc/ssh failed",
        "value -1.5e3 and 42": "value <num> and <num>",
        "2024-01-02 03:04:05 start blk_123": "<date> <ip> start <id>",
        "": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "a string, b string").select("a", "b", T.normalize(F.col("a")).alias("x")).collect()
    assert {r["a"]: r["x"] for r in rows} == cases
    assert one(spark, T.normalize(F.col("a")), a=None) == ""


def test_tokens_and_buckets(spark):
    t = T.tokens(F.col("a"))
    assert one(spark, t, a="<num> got a_b 12, <*>") == ["<num>", "got", "a_b", "12", ",", "<", "*", ">"]
    assert one(spark, T.bucket_key(t), a="<num> got 12 end").asDict() == {"n": 4, "head": "got|12", "tail": "end"}
    assert one(spark, T.bucket_key(t), a="<num>").asDict() == {"n": 1, "head": "|", "tail": ""}


def test_similarity_and_merge(spark):
    a, b = F.split("a", " "), F.split("b", " ")
    assert one(spark, T.similarity(a, b), a="x <num> z", b="x 7 <*>") == 1.0
    assert one(spark, T.similarity(a, b), a="x y", b="x z") == 0.5
    assert one(spark, T.similarity(a, b), a="x", b="x z") == 0.0
    assert one(spark, T.merge_template(a, b), a="x <num> z", b="x <id> y") == ["x", "<num>", "<*>"]


def test_template_guess(spark):
    assert one(spark, T.template_guess(F.split("a", " ")), a="close ( <num> ) , a . b < * >") == "close (<num>), a. b <*>"


def test_answers(spark):
    assert one(spark, T.extract_template(F.col("a")), a="x <START> a  <*>\n b <END> y <END>") == "a <*> b"
    assert one(spark, T.extract_template(F.col("a")), a="nothing") == ""
    assert one(spark, T.extract_template_loosely(F.col("a")), a=" nothing ") == "nothing"
    assert one(spark, T.event_id(F.col("a")), a="") == ""


def test_signature(spark):
    assert one(spark, T.signature(F.col("a")), a="Send  10.0.0.1:5 to 0xAB of 12 ab1cd2 x") == "Send <*> to <*> of <*> <*> x"


def test_validate(spark):
    v = P.validate(F.col("a"), F.col("b"))
    assert one(spark, v, a="user 7 did x", b="user <*> did <*>").asDict() == {"valid": True, "errors": [], "replacements": ["7", "x"]}
    bad = one(spark, v, a="user 7", b="host <*>")
    assert not bad["valid"] and bad["errors"] == ["host"]
    assert one(spark, v, a="user", b=" ")["errors"] == ["<EMPTY_TEMPLATE>"]
    assert one(spark, v, a="user", b="<*>")["valid"]


def test_match(spark):
    m = P.match(F.col("a"), P.pattern(F.col("b")))
    assert one(spark, m, a="connection from host 7 closed", b="connection from host <*> closed") is not None
    assert one(spark, m, a="x connection from host 7 closed", b="connection from host <*> closed") is None
    assert one(spark, m, a="short 1", b="short <*>") is None


def test_prompt(spark):
    rows = spark.createDataFrame([("q", [("c", "t")])], "q string, d array<struct<content:string,template:string>>")
    text = rows.select(T.build_input(F.col("q"), F.col("d")).alias("x")).first()["x"]
    assert text == "Examples:\n<content>c\n<template><START>t<END>\n\nQuery:\n<content>q\n<template>"
    assert one(spark, T.split_sequence(F.col("a")), a=" a ;-; b ;-;  ") == ["a", "b"]
