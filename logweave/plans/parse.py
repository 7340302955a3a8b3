"""Parsing logs into templates: by joins over whole sets, or in order with caches that change as they are used."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import templates as P
from logweave.functions import text as T
from logweave.operators.retrieve import demonstrations, top_k


#: From content, demonstrations (the best last; None for none) and the number of the attempt to the raw answer.
Generator = Callable[..., Column]
DEMOS = "array<struct<rank:int,line_id:bigint,content:string,template:string,score:double>>"


def signature_generator(content: Column, demos: Column | None = None, attempt: int = 1) -> Column:
    """The default generator: the log's signature as its template, in the answer's tags."""
    return T.template_answer(T.signature(content))


def nearest_generator(content: Column, demos: Column | None = None, attempt: int = 1) -> Column:
    """The template of the best demonstration at first, then the log's signature."""
    if demos is None or attempt > 1:
        return signature_generator(content)
    return T.template_answer(F.coalesce(F.try_element_at(demos, F.lit(-1))["template"], F.lit("")))


def python_generator(make: Callable[[], Callable[[list], list[str]]], instruction: str = T.INSTRUCTION, chat: bool = False) -> Generator:
    """A generator from a Python model: `make` loads it once in each worker, and it answers batch by batch. It gets
    prompts as strings or, as a chat, lists of messages; rows that are answered already do not reach it."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for prompts in batches:
            asked = prompts.dropna()
            said = model([json.loads(x) for x in asked] if chat else list(asked)) if len(asked) else []
            yield pd.Series(list(said), index=asked.index, dtype=object).reindex(prompts.index)

    def generate(content: Column, demos: Column | None = None, attempt: int = 1) -> Column:
        shown = F.expr(f"cast(array() as {DEMOS})") if demos is None else demos
        asked = F.to_json(T.messages(content, shown, instruction)) if chat else F.concat(F.lit(instruction + "\n\n"), T.build_input(content, shown))
        return answer(F.when(content.isNotNull(), asked))

    return generate


def match_patterns(logs: DataFrame, bank: DataFrame) -> DataFrame:
    """(dataset, content, template) of distinct logs and the bank pattern of the best score; ties go to the later one.

    A log meets the patterns of its own dataset only; a pattern must hold the log's longest constant part, which is a
    cheap test before the walk."""
    patterns = bank.select("dataset", F.col("ord").alias("_ord"), P.pattern(F.col("event_template")).alias("p")).where(P.admissible(F.col("p")))
    longest = F.aggregate("p.parts", F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    patterns = patterns.withColumn("_needle", longest)
    pairs = logs.select("dataset", "content").distinct().join(patterns, "dataset").where(F.contains("content", F.col("_needle")))
    scored = pairs.withColumn("score", P.match(F.col("content"), F.col("p"))).where("score is not null")
    return scored.groupBy("dataset", "content").agg(F.max_by("p.template", F.struct("score", "_ord")).alias("template"))


def _look_up(logs: DataFrame, bank: DataFrame) -> DataFrame:
    """(dataset, content, query, _exact, _sign, _pattern) of distinct logs: what each level of look-up answers. query is the
    place of the content's first log. Patterns are tried for logs that no other level answers."""
    asked = logs.groupBy("dataset", "content").agg(F.min("ord").alias("query"))
    known = bank.where("event_template is not null and event_template <> ''")
    exact = known.groupBy("dataset", "content").agg(F.max_by("event_template", "ord").alias("_exact"))
    signed = known.select("dataset", T.signature(F.col("content")).alias("_sig"), "event_template", "ord")
    named = asked.withColumns({"_sig": T.signature(F.col("content")), "_plain": T.squeeze(F.col("content"))})
    tries = named.where("_sig <> _plain").join(signed, ["dataset", "_sig"])
    tries = tries.withColumn("v", P.validate(F.col("content"), F.col("event_template"))).where("v.valid")
    p = P.pattern(F.col("event_template"))
    m = P.match(F.col("content"), p)
    rank = F.struct(F.when(m.isNotNull(), 2).otherwise(1).alias("s0"), F.coalesce(m, P.plain_score(p)).alias("s"))
    by_sign = tries.withColumn("rank", rank).groupBy("dataset", "content").agg(F.max_by("event_template", F.struct("rank", "ord")).alias("_sign"))
    found = asked.join(exact, ["dataset", "content"], "left").join(by_sign, ["dataset", "content"], "left")
    patterns = match_patterns(found.where("_exact is null and _sign is null"), known).withColumnRenamed("template", "_pattern")
    return found.join(patterns, ["dataset", "content"], "left")


def _source(valid: Column) -> Column:
    return F.when(F.col("_exact").isNotNull(), "exact_cache").when(F.col("_sign").isNotNull(), "signature_cache").when(F.col("_pattern").isNotNull(), "pattern_cache").when(valid, "llm").otherwise("failed")


def _same(logs: DataFrame, contents: DataFrame) -> DataFrame:
    """Logs (l) with what is known of their content (f), null ones too."""
    same = F.col("l.dataset").eqNullSafe(F.col("f.dataset")) & F.col("l.content").eqNullSafe(F.col("f.content"))
    return logs.alias("l").join(contents.alias("f"), same)


def parse_sets(logs: DataFrame, bank: DataFrame, generator: Generator = signature_generator) -> DataFrame:
    """Predictions of all logs by joins: a bank log of equal content, of equal signature whose template is valid, a
    bank pattern, or else the generator, run once for each distinct content and checked.

    The order of look-ups is that of the ordered mode. Its results differ where that mode's caches drop entries or learn
    from earlier logs of the same run. A null content fails; no logs give no rows, and an empty bank leaves all to the
    generator."""
    found = _look_up(logs, bank)
    found = found.withColumn("_made", F.when(F.coalesce("_exact", "_sign", "_pattern").isNull(), T.extract_template(generator(F.col("content")))))
    valid = (F.col("_made") != "") & P.validate(F.col("content"), F.col("_made"))["valid"]
    answer = F.coalesce("_exact", "_sign", "_pattern", F.when(valid, F.col("_made")), F.lit(""))
    decided = found.select("dataset", "content", T.squeeze(answer).alias("predicted_template"), _source(valid).alias("decision_source"))
    return _same(logs, decided).select("l.dataset", "ord", "line_id", "l.content", "event_template", "predicted_template", "decision_source")


def predictions(logs: DataFrame, bank: DataFrame, generator: Generator = signature_generator, shots: int = 5, attempts: int = 1, field: str = "content") -> DataFrame:
    """The whole record of each log: look-ups as in parse_sets; a content that they leave open gets the best `shots` logs of
    its dataset's bank (none of equal content) as demonstrations, and the generator is asked up to `attempts` times until an
    answer is valid. Logs of null content, and those of an empty bank, get no demonstration. Joins keep no clock for a row,
    so the times are null."""
    found = _look_up(logs, bank)
    open_ = found.where("_exact is null and _sign is null and _pattern is null").select("dataset", "content", "query")
    if shots > 0:
        keyed = bank.withColumns({"key": F.col("ord"), "_line": F.col("line_id").cast("string")})
        shown = demonstrations(top_k(open_, keyed, shots, ["_line", "content"], field), keyed).withColumn("demos", F.col("demos").cast(DEMOS))
        open_ = open_.join(shown, ["dataset", "query"], "left")
    else:
        open_ = open_.withColumn("demos", F.lit(None).cast(DEMOS))
    open_ = open_.withColumn("demos", F.coalesce("demos", F.expr(f"cast(array() as {DEMOS})")))
    best_last = F.reverse("demos")
    open_ = open_.withColumns({"raw": F.lit(None).cast("string"), "made": F.lit(""), "valid": F.lit(False), "tries": F.lit(0)})
    for k in range(1, attempts + 1):
        asked = F.when(~F.col("valid"), F.col("content"))  # null: answered already
        open_ = open_.withColumn("raw", F.when(F.col("valid"), F.col("raw")).otherwise(generator(asked, best_last, k)))
        open_ = open_.withColumns({"made": F.coalesce(T.extract_template(F.col("raw")), F.lit("")), "tries": F.when(F.col("valid"), F.col("tries")).otherwise(k)})
        open_ = open_.withColumn("valid", F.coalesce((F.col("made") != "") & P.validate(F.col("content"), F.col("made"))["valid"], F.lit(False)))
    told = open_.select(
        "dataset", "query", "raw", "made", "valid", "tries", F.size("demos").alias("shown"),
        F.array_join(F.transform("demos", lambda d: d["line_id"].cast("string")), "|").alias("lines"),
        F.array_join(F.transform("demos", lambda d: F.format_string("%.6f", d["score"])), "|").alias("scores"),
    )
    decided = found.join(told, ["dataset", "query"], "left")
    valid = F.coalesce("valid", F.lit(False))
    answer = F.coalesce("_exact", "_sign", "_pattern", F.when(valid, F.col("made")), F.lit(""))
    decided = decided.select("dataset", F.col("query").alias("_query"), T.squeeze(answer).alias("predicted_template"), _source(valid).alias("decision_source"), "raw", "tries", "shown", "lines", "scores")
    first = logs.groupBy("dataset", "content").agg(F.min("ord").alias("_query"))
    rows = _same(logs, first).select("l.*", "_query").join(decided, ["dataset", "_query"])
    source, none = F.col("decision_source"), F.lit(None).cast("double")
    times = [none.alias(c) for c in ("latency_ms", "cache_lookup_ms", "retrieval_ms", "prompt_build_ms", "llm_query_ms", "validation_ms")]
    return rows.select(
        "dataset", "ord", F.col("line_id").cast("string").alias("line_id"), "content", "predicted_template", "decision_source", source.endswith("_cache").alias("cache_hit"),
        *[(source == f"{x}_cache").alias(f"{x}_cache_hit") for x in ("exact", "signature", "pattern")], F.coalesce("shown", F.lit(0)).alias("num_demos"), *times,
        F.coalesce("tries", F.lit(0)).alias("model_attempts"), F.coalesce("raw", F.lit("")).alias("raw_response"), F.col("event_template").alias("ground_truth_template"),
        F.coalesce("lines", F.lit("")).alias("demo_line_ids"), F.coalesce("scores", F.lit("")).alias("demo_scores"),
    )


class _Recent(OrderedDict):
    """A map of bounded size that forgets what was used longest ago."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def use(self, key):
        if key in self:
            self.move_to_end(key)
            return self[key]
        return None

    def keep(self, key, value) -> None:
        self[key] = value
        self.move_to_end(key)
        while len(self) > self.most:
            self.popitem(last=False)


class TemplateCaches:
    """Exact, signature and pattern look-ups that learn from every answer. Signatures come with the rows."""

    SIGNATURE_CANDIDATES = 32  # fixed value

    def __init__(self, exact: int = 50_000, signature: int = 10_000, patterns: int = 10_000, version: str = "v2"):
        self.exact, self.signed, self.patterns, self.version = _Recent(exact), _Recent(signature), _Recent(patterns), version

    @staticmethod
    def features(template: str) -> dict:
        import re

        t = " ".join(template.split())
        parts = [x.strip() for x in t.split(T.WILD) if x.strip()]
        return {"t": t, "parts": parts, "chars": sum(map(len, parts)), "words": sum(len(re.findall("[A-Za-z0-9]+", x)) for x in parts), "wild": t.count(T.WILD), "start": not t.startswith(T.WILD), "end": not t.endswith(T.WILD)}

    @staticmethod
    def valid(log: str, template: str) -> bool:
        at = 0
        for part in (x.strip() for x in template.split(T.WILD)):
            if part:
                found = log.find(part, at)
                if found < 0:
                    return False
                at = found + len(part)
        return bool(template)

    @staticmethod
    def general(f: dict) -> bool:
        return f["wild"] > 0 and f["chars"] >= T.LEAST_CHARS and f["words"] >= T.LEAST_TOKENS

    def score(self, log: str, f: dict) -> tuple | None:
        if not self.general(f):
            return None
        at, first = 0, None
        for part in f["parts"]:
            found = log.find(part, at)
            if found < 0:
                return None
            first, at = found if first is None else first, found + len(part)
        cover = f["chars"] / max(1, len(log))
        if (f["start"] and first) or (f["end"] and at != len(log)) or cover < (T.LEAST_COVERAGE if f["start"] or f["end"] else T.LEAST_COVERAGE_LOOSE):
            return None
        return f["chars"], f["words"], int(cover * 1000), int(f["start"]), int(f["end"]), -f["wild"]

    def look(self, log: str, sign: str) -> tuple[str, str] | None:
        hit = self.exact.use(log)
        if hit is not None:
            return hit, "exact_cache"
        if sign != " ".join(log.split()) and (held := self.signed.use(sign)):
            def rank(f: dict) -> tuple:
                s = self.score(log, f)
                return (2, *s) if s else (1, int(f["start"]), int(f["end"]), f["chars"], f["words"], -f["wild"], int(f["wild"] > 0))

            fine = [f for f in held if self.valid(log, f["t"])]
            if fine:
                best = max(fine, key=rank)  # the first of equals is the latest
                self.exact.keep(log, best["t"])
                self.signed.keep(sign, [best, *(f for f in held if f["t"] != best["t"])][: self.SIGNATURE_CANDIDATES])
                if self.version == "v1" or self.general(best):
                    self.patterns.keep(best["t"], best)
                return best["t"], "signature_cache"
        newest = list(reversed(self.patterns.values()))
        if self.version == "v1":
            best = next((f for f in newest if self.valid(log, f["t"])), None)
            if best is not None:
                self.exact.keep(log, best["t"])
        else:
            scored = [(s, f) for f in newest if (s := self.score(log, f))]
            best = max(scored, key=lambda x: x[0])[1] if scored else None
        if best is None:
            return None
        self.patterns.keep(best["t"], best)
        return best["t"], "pattern_cache"

    def learn(self, log: str, sign: str, template: str) -> None:
        f = self.features(template)
        self.exact.keep(log, f["t"])
        if sign != " ".join(log.split()) and self.valid(log, f["t"]):
            held = self.signed.use(sign) or []
            self.signed.keep(sign, [f, *(x for x in held if x["t"] != f["t"])][: self.SIGNATURE_CANDIDATES])
        if self.version == "v1" or self.general(f):
            self.patterns.keep(f["t"], f)


def fold(rows: Iterable[tuple[str, str, str]], caches: TemplateCaches) -> list[tuple[str, str]]:
    """(template, source) of rows (log, signature, generated template) in order."""
    out = []
    for log, sign, made in rows:
        found = caches.look(log, sign)
        if found is None:
            if made and caches.valid(log, made):
                caches.learn(log, sign, made)
                found = (made, "llm")
            else:
                found = ("", "failed")
        out.append(found)
    return out


def parse_ordered(logs: DataFrame, generator: Generator = signature_generator, group: tuple[str, ...] = ("dataset",), **sizes: int | str) -> DataFrame:
    """The same row after row: each answer teaches the caches, which belong to one group. Sequential in a group by
    definition; split a large dataset by a further group column where its order does not matter."""
    made = logs.withColumns({"_sig": T.signature(F.col("content")), "_made": T.extract_template(generator(F.col("content")))})
    cols = list(dict.fromkeys([*group, "dataset", "ord", "line_id", "content", "event_template"]))
    kinds = dict(logs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", predicted_template string, decision_source string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        done = fold(zip(pdf["content"], pdf["_sig"], pdf["_made"], strict=True), TemplateCaches(**sizes))
        return pdf[cols].assign(predicted_template=[t for t, _ in done], decision_source=[s for _, s in done])

    return made.select(*cols, "_sig", "_made").groupBy(*group).applyInPandas(run, schema)


def parse_sequences(rows: DataFrame, bank: DataFrame, separator: str = " ;-; ") -> DataFrame:
    """rows (dataset, ord, content of many logs) with Template: the templates of its logs in order, failed ones empty."""
    parts = rows.select("dataset", "ord", F.posexplode(T.split_sequence(F.col("content"))).alias("pos", "content"))
    # ord names the row and line_id the place in it, so a log of parse_sets has both
    single = parts.select("dataset", "ord", F.col("pos").cast("long").alias("line_id"), "content", F.lit(None).cast("string").alias("event_template"))
    done = parse_sets(single, bank).select("dataset", "ord", "line_id", "predicted_template")
    joined = done.groupBy("dataset", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "predicted_template"))), lambda x: x["predicted_template"]), separator).alias("Template"))  # the logs of one row
    return rows.join(joined, ["dataset", "ord"], "left").withColumn("Template", F.coalesce("Template", F.lit("")))
