"""Secret scans (operator 9), DataFrame expressions only.

Three base kinds come from patterns (assign, access, hex). The method adds the kind `entropy`: candidate strings whose
Shannon entropy, in some window of WINDOW characters, reaches the limit of their character class, unless an allow-list
pattern suppresses them or they overlap a base span. The entropy of the windows is carried along the string: the state
holds the count of every character in the window, and each step adds the incoming character's and takes off the outgoing
one's. A step costs the same anywhere, so work grows with a candidate's length.

Positions are code points. Null texts count as empty; equal or repeated rows each get their own result; an empty table
gives an empty result; extra columns of the input are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

# The base patterns, as the contract states them. A run of 24+ hex digits, or AKIA and 16+ more, is the
# same match as the open-ended pattern with a length check, since both take the whole run.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates for the entropy test: 20 or more of these characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least bits by character class: (pattern of the whole candidate, bits). Letters only count if both cases occur; beyond
#: letters only and digits only, a candidate holds a letter and a digit.
CLASSES = ((r"^[0-9]+$", 3.2), (r"^[A-Za-z]+$", 3.9), (r"^[0-9a-fA-F]+$", 2.81), (r"^[A-Za-z0-9]+$", 3.51), (r"^[A-Za-z0-9+/_=-]+$", 3.61))
MIXED = (r"[0-9]", r"[A-Za-z]"), (r"[A-Z]", r"[a-z]")
#: Candidates that hold one of these are placeholders, not secrets.
ALLOWED = r"(?i)example|sample|dummy|placeholder|redacted|x{6,}|0123456789|abcdefghij|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"

_SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
#: Matches that one fold gathers; longer lists are folded part by part.
PART = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _spans(text: Column, pattern: str, kind: int, may: Column, group: int = 0) -> Column:
    """Leftmost matches that do not overlap, as structs (start, kind, end, text of the group).

    may: a cheap condition that every text with a match meets. Places are running sums of lengths, taken in parts of PART
    matches whose starts come from the sums of the parts before."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    steps = F.transform(zipped, lambda x: F.struct(F.length(x.getField("gap")).alias("g"), F.length(x.getField("hit")).alias("h"), x.getField("value").alias("v")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["g"]
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + x["h"]).alias("e"), x["v"].alias("v"))
        return F.struct((start + x["h"]).alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    none = F.expr(f"cast(array() as {_SPAN})")
    part = lambda x, c: F.slice(x, c * PART + 1, F.lit(PART))
    parts = lambda x: _upto(F.ceil(F.size(x) / PART).cast("int"))
    sums = lambda x: F.transform(parts(x), lambda c: F.aggregate(part(x, c), F.lit(0), lambda a, y: a + y["g"] + y["h"]))
    before = lambda z, c: F.aggregate(F.slice(z["sums"], F.lit(1), c), F.lit(0), lambda a, y: a + y)
    fold = lambda z, c: F.aggregate(part(z["steps"], c), F.struct(before(z, c).alias("pos"), none.alias("out")), add, lambda acc: acc["out"])
    found = _let(
        F.filter(steps, lambda x: x["h"].isNotNull()),
        lambda x: _let(F.struct(x.alias("steps"), sums(x).alias("sums")), lambda z: F.flatten(F.transform(parts(z["steps"]), lambda c: fold(z, c)))),
    )
    return F.when(may, found).otherwise(none)


def peak_entropy(value: Column, window: int = WINDOW) -> Column:
    """The most bits per character in any window of the string, shorter strings as one window.

    State: the count of each character in the current window and the sum of c*log2(c) over them."""

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def walk(slots: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(slots, i), F.when(i >= window, F.get(slots, i - window)).otherwise(F.lit(-1))
            gone = F.when(old >= 0, F.get(acc["counts"], old)).otherwise(F.lit(0))
            had = F.get(acc["counts"], new) - F.when(new == old, F.lit(1)).otherwise(F.lit(0))
            total = acc["total"] - weight(gone) + weight(gone - 1) + weight(had + 1) - weight(had)
            counts = F.when(new == old, acc["counts"]).otherwise(F.transform(acc["counts"], lambda c, j: F.when(j == new, c + 1).when(j == old, c - 1).otherwise(c)))
            size = F.least(i + 1, F.lit(window)).cast("double")
            bits = F.log2(size) - total / size
            best = F.when((i + 1 >= window) | (i + 1 == F.size(slots)), F.greatest(acc["best"], bits)).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

        zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(_upto(F.size(slots)), zero, step, lambda acc: acc["best"])

    letters = F.filter(F.split(value, ""), lambda c: c != "")
    return _let(F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c) - 1), walk)


def _suspect(value: Column) -> Column:
    limit = F.lit(9.0)
    for pattern, bits in reversed(CLASSES):
        limit = F.when(value.rlike(pattern), F.lit(bits)).otherwise(limit)
    one, two = (value.rlike(a) & value.rlike(b) for a, b in MIXED)
    return (one | value.rlike(CLASSES[0][0]) | (two & value.rlike(CLASSES[1][0]))) & ~value.rlike(ALLOWED) & (peak_entropy(value) >= limit)


def with_spans(docs: DataFrame, text: str = "text", out: str = "_spans", base: str = "_base") -> DataFrame:
    """docs with two array columns: the base spans, and all spans, each ordered by start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    has = lambda x: F.contains(t, F.lit(x))
    # access and hex matches are runs of candidate characters too, so one look tells most texts apart from all three
    docs = docs.withColumn(out, t.rlike(CANDIDATE))
    long = F.col(out)
    assign = F.filter(_spans(t, ASSIGN, 0, (has(":") | has("=")) & t.rlike(ASSIGN), 2), lambda x: F.length(x["v"]) >= 6)
    found = docs.withColumn(base, F.array_sort(F.concat(assign, _spans(t, ACCESS, 1, long & has("AKIA")), _spans(t, HEX, 2, long))))
    b = F.col(base)
    added = F.filter(_spans(t, CANDIDATE, 3, long), lambda x: _suspect(x["v"]) & ~F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return found.withColumn(out, F.array_sort(F.concat(b, added)))


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans."""
    found = with_spans(docs.select(key, text), text)
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        key,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by the mark; null texts stay null, n_chars follows if it is there."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("t"))
    found = with_spans(wrapped, "t")
    t = F.col("t")

    # spans that overlap are one; their ends are taken in order, so that each piece between them is cut out once
    def step(acc: Column, x: Column) -> Column:
        new = x["s"] >= acc["pos"]
        gap = F.struct(acc["pos"].alias("s"), x["s"].alias("e"))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(new, F.concat(acc["gaps"], F.array(gap))).otherwise(acc["gaps"]).alias("gaps"))

    zero = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("gaps"))
    whole = lambda acc: F.concat(acc["gaps"], F.array(F.struct(acc["pos"].alias("s"), F.length(t).alias("e"))))
    gaps = F.aggregate("_spans", zero, step, whole)
    clean = F.array_join(F.transform(gaps, lambda x: F.substr(t, x["s"] + 1, x["e"] - x["s"])), mark)
    found = found.select("row", F.when(F.size("_spans") > 0, clean).alias("clean"))
    new = {text: F.coalesce("clean", F.col("row")[text]), "n_chars": F.coalesce(F.length("clean").cast("long"), F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
