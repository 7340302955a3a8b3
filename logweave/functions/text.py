"""Column builders for log text: masks, tokens, templates, prompts.

Python's regular expressions read \\d, \\w, \\s and \\b as Unicode; the flag (?U) makes Java's do the same."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The masks of normalised content, in the order in which they apply.
MASKS = (
    (r"\b(?:https?|ftp)://\S+", " <URL> "),
    (r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b", " <EMAIL> "),
    (r"(?<![A-Za-z0-9_])(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?(?![A-Za-z0-9_])", " <IP> "),
    (r"(?<![A-Za-z0-9_])(?:[A-Fa-f0-9]{1,4}:){2,}[A-Fa-f0-9]{1,4}(?::\d+)?(?![A-Za-z0-9_])", " <IP> "),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", " <UUID> "),
    (r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[T\s]\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)?\b", " <DATE> "),
    (r"\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b", " <TIME> "),
    (r"\b0x[0-9a-fA-F]+\b|\b[0-9a-fA-F]{12,}\b", " <HEX> "),
    (r"(?i)\b(?:blk|block|job|task|attempt|app|application|container|executor|stage|rdd|core|pid|tid|node|host|port)[-_:.]?[A-Za-z0-9_.:-]*\d[A-Za-z0-9_.:-]*\b", " <ID> "),
)
# Paths, and the roots under which they vary.
PATH = r"(?<!\w)(?:/[A-Za-z0-9._+\-=:@%]+){2,}(?:/[A-Za-z0-9._+\-=:@%]*)?"
VARIABLE_ROOTS = ("/tmp/", "/var/tmp/", "/mnt/", "/data/", "/home/", "/user/", "/users/", "/export/")
LONG_PATH = 24
LATE_MASKS = (
    (r"\b(?=[A-Za-z0-9_.:-]*\d)(?=[A-Za-z0-9_.:-]*[A-Za-z])[A-Za-z0-9_.:-]{8,}\b", " <ID> "),
    (r"(?<![A-Za-z0-9_])[-+]?\d+\.\d+(?:[eE][-+]?\d+)?(?![A-Za-z0-9_])", " <NUM> "),
    (r"(?<![A-Za-z0-9_])[-+]?\d+(?![A-Za-z0-9_])", " <NUM> "),
)
# Tokens of clustering and of retrieval, and placeholders among them.
TOKEN = r"<[a-z_]+>|[A-Za-z_]+|[0-9]+|[^\sA-Za-z_0-9]"
QUERY_TOKEN = r"<[a-z_]+>|[A-Za-z_]+|\d+|[^\sA-Za-z_0-9]"
PLACEHOLDER = r"^<[a-z_]+>$"
# The masks of a log's signature, in order.
SIGNATURE_MASKS = (
    r"\b[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\b",
    r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b",
    r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b",
    r"\b0x[0-9A-Fa-f]+\b",
    r"\b[-+]?(?:\d+\.\d+|\d+)\b",
    r"\b(?=\S*\d)(?=\S*[A-Za-z])[A-Za-z0-9_./:=+-]{5,}\b",
)
WILD = "<*>"
# Blanks that a template guess does without.
TIDY = ((r"\s+([,.;:!?\]\)\}])", "$1"), (r"([\[\(\{])\s+", "$1"), (r"<\s+([a-z_]+)\s+>", "<$1>"), (r"\s+([./:-])\s+", "$1"))
# Limits of pattern matching, and the largest line number of an unreadable one.
LEAST_CHARS, LEAST_TOKENS, LEAST_COVERAGE, LEAST_COVERAGE_LOOSE = 12, 2, 0.20, 0.35
NO_LINE, NO_SAMPLE_LINE, NO_RANK = 2**63 - 1, 10**18, 10**9
# Prompt texts.
INSTRUCTION = (
    "For each query log after the final <content> tag, try your best to extract one log template "
    "(substitute variable tokens in the log as <*> and remain constant tokens to construct the template) "
    "and put the template after the final <template> tag and between <START> and <END> tags. "
    "Use previous <content>/<template> pairs as in-context examples when they are provided."
)
TRAINING_SYSTEM = "You are a log parsing assistant that converts raw log messages into templates."
ONLINE_SYSTEM = "You are a log parsing assistant that extracts templates from logs."


def _u(pattern: str) -> str:
    return "(?U)" + pattern


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _u(r"^\s+|\s+$"), "")


def squeeze(text: Column) -> Column:
    """Outer white space gone, inner runs one blank."""
    return F.regexp_replace(strip(text), _u(r"\s+"), " ")


def mask_paths(text: Column) -> Column:
    """Paths that are long, hold a digit or start at a variable root become <PATH>; the rest stay."""
    cut = F.split(F.regexp_replace(text, _u(f"({PATH})"), "\u0001$1\u0001"), "\u0001", -1)

    def one(part: Column, i: Column) -> Column:
        low = F.lower(part)
        rooted = F.lit(False)
        for root in VARIABLE_ROOTS:
            rooted = rooted | low.startswith(root)
        variable = part.rlike(_u(r"\d")) | (F.length(part) >= LONG_PATH) | rooted
        return F.when((i % 2 == 1) & variable, F.lit(" <PATH> ")).otherwise(part)

    return F.array_join(F.transform(cut, one), "")


def normalize(text: Column) -> Column:
    """Variable parts replaced by placeholders in order, blanks squeezed, lower case."""
    out = strip(F.coalesce(text, F.lit("")))
    for pattern, mark in MASKS:
        out = F.regexp_replace(out, _u(pattern), mark)
    out = mask_paths(out)
    for pattern, mark in LATE_MASKS:
        out = F.regexp_replace(out, _u(pattern), mark)
    return F.lower(squeeze(out))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_u(f"({TOKEN})")), F.lit(1))


def query_tokens(text: Column) -> Column:
    """Lower-cased tokens of retrieval; digits of any script count."""
    return F.regexp_extract_all(F.lower(text), F.lit(_u(f"({QUERY_TOKEN})")), F.lit(1))


def stable(toks: Column) -> Column:
    return F.filter(toks, lambda x: ~x.rlike(PLACEHOLDER))


def bucket_key(toks: Column) -> Column:
    """(number of tokens, first|second stable token, last stable token)."""
    s = stable(toks)
    at = lambda i: F.coalesce(F.try_element_at(s, F.lit(i)), F.lit(""))
    return F.struct(F.size(toks).alias("n"), F.concat(at(1), F.lit("|"), at(2)).alias("head"), at(-1).alias("tail"))


def similarity(toks: Column, template: Column) -> Column:
    """Share of places that agree; places with <*> do not count, a placeholder on either side agrees."""
    pairs = F.arrays_zip(toks.alias("a"), template.alias("b"))
    counted = F.filter(pairs, lambda p: p["b"] != WILD)
    agree = F.filter(counted, lambda p: (p["a"] == p["b"]) | p["a"].rlike(PLACEHOLDER) | p["b"].rlike(PLACEHOLDER))
    return F.when(F.size(toks) != F.size(template), 0.0).when(F.size(counted) == 0, 1.0).otherwise(F.size(agree) / F.size(counted))


def merge_template(template: Column, toks: Column) -> Column:
    both = lambda a, b: a.rlike(PLACEHOLDER) & b.rlike(PLACEHOLDER)
    return F.zip_with(template, toks, lambda a, b: F.when((a == b) | both(a, b), a).otherwise(F.lit(WILD)))


def template_guess(toks: Column) -> Column:
    """Tokens joined by blanks, then blanks around brackets and signs taken out."""
    out = F.array_join(toks, " ")
    for pattern, by in TIDY:
        out = F.regexp_replace(out, _u(pattern), by)
    return F.replace(out, F.lit("< * >"), F.lit(WILD))


def line_number(text: Column, missing: int = NO_LINE) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(missing))


def symbols(text: Column, skip: str = "") -> Column:
    """Characters that are neither letters, digits nor white space, nor in skip."""
    return F.length(F.regexp_replace(text, _u(rf"[\p{{L}}\p{{N}}\s{re.escape(skip)}]"), ""))


def complexity(content: Column, normalized: Column) -> Column:
    """(length, tokens, symbols, placeholders, has a path), compared from the left."""
    marks = F.size(F.filter(tokens(normalized), lambda x: x.rlike(PLACEHOLDER)))
    return F.struct(F.length(content).alias("c1"), F.size(tokens(content)).alias("c2"), symbols(content).alias("c3"), marks.alias("c4"), F.contains(content, F.lit("/")).cast("int").alias("c5"))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a & b| / |a | b| of two sets held as arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1.0 - F.size(F.array_intersect(a, b)) / union)


def signature(text: Column) -> Column:
    """A log with its variable parts as <*>; case stays."""
    out = squeeze(text)
    for pattern in SIGNATURE_MASKS:
        out = F.regexp_replace(out, _u(pattern), WILD)
    return squeeze(out)


def event_id(template: Column) -> Column:
    return F.when(template == "", "").otherwise(F.substring(F.md5(template), 1, 8))


def template_answer(template: Column) -> Column:
    return F.concat(F.lit("<START>"), template, F.lit("<END>"))


def extract_template(response: Column) -> Column:
    """What stands between the first <START> and the next <END>; empty without them."""
    return squeeze(F.regexp_extract(F.coalesce(response, F.lit("")), _u(r"(?s)<START>\s*(.+?)\s*<END>"), 1))


def extract_template_loosely(response: Column) -> Column:
    """The same, but the whole text without the tags."""
    text = F.coalesce(response, F.lit(""))
    tagged = _u(r"(?s)<START>\s*(.+?)\s*<END>")
    return F.when(text.rlike(tagged), strip(F.regexp_extract(text, tagged, 1))).otherwise(strip(text))


def build_input(query: Column, demos: Column) -> Column:
    """Prompt body: the demonstrations (structs with content and template), then the query."""
    shown = F.transform(demos, lambda d: F.concat(F.lit("<content>"), d["content"], F.lit("\n<template>"), template_answer(d["template"]), F.lit("\n\n")))
    head = F.when(F.size(demos) > 0, F.concat(F.lit("Examples:\n"), F.array_join(shown, ""), F.lit("Query:\n"))).otherwise("")
    return F.regexp_replace(F.concat(head, F.lit("<content>"), query, F.lit("\n<template>")), _u(r"\s+$"), "")


def messages(query: Column, demos: Column, instruction: str = INSTRUCTION, system: str | None = ONLINE_SYSTEM) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user = turn("user", F.concat(F.lit(instruction + "\n\n"), build_input(query, demos)))
    return F.array(turn("system", F.lit(system)), user) if system else F.array(user)


def instruction_record(query: Column, template: Column, demos: Column) -> Column:
    return F.to_json(F.struct(F.lit(INSTRUCTION).alias("instruction"), build_input(query, demos).alias("input"), template_answer(template).alias("output")))


def chat_record(query: Column, template: Column, demos: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    said = F.array(turn("system", F.lit(TRAINING_SYSTEM)), turn("user", F.concat(F.lit(INSTRUCTION + "\n\n"), build_input(query, demos))), turn("assistant", template_answer(template)))
    return F.to_json(F.struct(said.alias("messages")))


def split_sequence(text: Column) -> Column:
    """Logs of a sequence row, split at ;-; and stripped; empty ones go."""
    return F.filter(F.transform(F.split(strip(F.coalesce(text, F.lit(""))), _u(r"\s*;-;\s*"), -1), strip), lambda x: x != "")


def sanitize_label(text: Column, collapse: bool = True) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]" + ("+" if collapse else ""), "_")


def support_scope(dataset: Column) -> Column:
    """The bank that serves a dataset: all banks (*) for Liberty, HDFS for HDFS_v1, else its own."""
    return F.when(dataset == "Liberty", "*").when(dataset == "HDFS_v1", "HDFS").otherwise(dataset)


def prompt_and_answer(row: Column, form: str) -> tuple[Column, Column]:
    """Prompt and expected answer of a training record held as a struct: `instruction` or `chat` form."""
    if form == "instruction":
        return F.concat(row["instruction"], F.lit("\n\n"), row["input"]), row["output"]
    turns = row["messages"]
    said = lambda role: F.element_at(F.filter(turns, lambda t: t["role"] == role), -1)["content"]
    return said("user"), said("assistant")
