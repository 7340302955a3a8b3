"""Columns for templates: validation against a log, pattern features, and pattern matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEAST_CHARS, LEAST_COVERAGE, LEAST_COVERAGE_LOOSE, LEAST_TOKENS, WILD, squeeze, strip


def constant_parts(template: Column) -> Column:
    """What stands between the wildcards, stripped, empty parts gone."""
    parts = F.transform(F.split(squeeze(template), r"<\*>", -1), strip)
    return F.filter(parts, lambda x: x != "")


def validate(log: Column, template: Column) -> Column:
    """(valid, errors, replacements) of a template for a log.

    The constant parts are sought left to right, each from the end of the one before; one not found is an error and
    does not move the place. The gaps passed over are the replacements; the log's end counts as a gap if any is left."""
    t = squeeze(template)
    texts = "array<string>"
    none = F.expr(f"cast(array() as {texts})")

    def step(acc: Column, part: Column) -> Column:
        at = F.call_function("locate", part, log, acc["pos"])
        hit = at > 0
        gap = F.when(hit & (at > acc["pos"]), F.array(strip(F.substr(log, acc["pos"], at - acc["pos"])))).otherwise(none)
        return F.struct(
            F.when(hit, at + F.length(part)).otherwise(acc["pos"]).alias("pos"),
            F.when(hit, acc["errors"]).otherwise(F.concat(acc["errors"], F.array(part))).alias("errors"),
            F.concat(acc["gaps"], gap).alias("gaps"),
        )

    zero = F.struct(F.lit(1).alias("pos"), none.alias("errors"), none.alias("gaps"))

    def finish(acc: Column) -> Column:
        rest = F.when(acc["pos"] <= F.length(log), F.array(strip(F.substr(log, acc["pos"], F.length(log))))).otherwise(none)
        return F.struct((F.size(acc["errors"]) == 0).alias("valid"), acc["errors"].alias("errors"), F.concat(acc["gaps"], rest).alias("replacements"))

    found = F.aggregate(constant_parts(t), zero, step, finish)
    empty = F.struct(F.lit(False).alias("valid"), F.array(F.lit("<EMPTY_TEMPLATE>")).alias("errors"), none.alias("replacements"))
    wild = F.struct(F.lit(True).alias("valid"), none.alias("errors"), none.alias("replacements"))
    return F.when(t == "", empty).when(t == WILD, wild).otherwise(found)


def pattern(template: Column) -> Column:
    """Features of a template: its constant parts, their characters and words, wildcards, and anchors."""
    t = squeeze(template)
    parts = constant_parts(t)
    words = F.aggregate(parts, F.lit(0), lambda a, x: a + F.size(F.regexp_extract_all(x, F.lit("([A-Za-z0-9]+)"), F.lit(1))))
    return F.struct(
        t.alias("template"),
        parts.alias("parts"),
        F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"),
        words.alias("words"),
        ((F.length(t) - F.length(F.replace(t, F.lit(WILD), F.lit("")))) / 3).cast("int").alias("wildcards"),
        (~t.startswith(WILD)).alias("anchored_start"),
        (~t.endswith(WILD)).alias("anchored_end"),
    )


def admissible(p: Column) -> Column:
    return (p["wildcards"] > 0) & (p["chars"] >= LEAST_CHARS) & (p["words"] >= LEAST_TOKENS)


def match(log: Column, p: Column) -> Column:
    """The score of an admissible pattern on a log, or null: (characters, words, coverage in thousandths, start, end,
    -wildcards). Parts are found leftmost in order; anchored ends must be met, and enough of the log be covered."""

    def step(acc: Column, part: Column) -> Column:
        at = F.call_function("locate", part, log, acc["pos"])
        alive = acc["alive"] & (at > 0)
        return F.struct(alive.alias("alive"), F.when(acc["first"] == 0, at).otherwise(acc["first"]).alias("first"), F.when(alive, at + F.length(part)).otherwise(acc["pos"]).alias("pos"))

    zero = F.struct(F.lit(True).alias("alive"), F.lit(0).alias("first"), F.lit(1).alias("pos"))
    walk = F.aggregate(p["parts"], zero, step)
    coverage = p["chars"] / F.greatest(F.length(log), F.lit(1))
    least = F.when(p["anchored_start"] | p["anchored_end"], LEAST_COVERAGE).otherwise(LEAST_COVERAGE_LOOSE)
    good = admissible(p) & walk["alive"] & (~p["anchored_start"] | (walk["first"] == 1)) & (~p["anchored_end"] | (walk["pos"] == F.length(log) + 1)) & (coverage >= least)
    score = F.struct(
        p["chars"].alias("s1"), p["words"].alias("s2"), F.floor(coverage * 1000).cast("int").alias("s3"),
        p["anchored_start"].cast("int").alias("s4"), p["anchored_end"].cast("int").alias("s5"), (-p["wildcards"]).alias("s6"),
    )
    return F.when(good, score)


def plain_score(p: Column) -> Column:
    """The score of a valid template that does not match as a pattern."""
    return F.struct(p["anchored_start"].cast("int").alias("s1"), p["anchored_end"].cast("int").alias("s2"), p["chars"].alias("s3"), p["words"].alias("s4"), (-p["wildcards"]).alias("s5"), (p["wildcards"] > 0).cast("int").alias("s6"))
