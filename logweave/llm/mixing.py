"""Mixing sources to target weights (operator 8): temperature mixing.

The token share of each source is raised to an exponent; the exponent is found by bisection so that the weights reach a
target entropy, or the most that a repetition limit allows. The weights then become budgets of tokens. A source's
documents lie in BLOCKS hash blocks of BLOCKS parts; each epoch is a permutation of the blocks by a seed, of the parts of
a block and of the documents of a part. A source is taken in whole epochs and then along one more permutation up to its
budget: whole blocks first, then parts of the block where the budget ends, and documents of the part where it ends. So
only totals are ever ordered as a whole, and where it ends is one place that every row compares its own with.

Targets that no exponent can meet together (a budget beyond the repetition limit, an entropy that the limit forbids) are
an error. Null sources are a source of their own; null and empty texts have no tokens and are taken as often as whole epochs say,
and once more if their place in the last permutation comes before the budget's end. Rows that repeat are rows each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import staged, table

BLOCKS = 1024


def tokens(text: str = "text") -> Column:
    """Words of the whole text: what blanks separate."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def weights_at(shares: dict, exponent: float) -> dict:
    raised = {k: v**exponent if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(good: Callable[[float], bool], low: float = 0.0, high: float = 1.0, rounds: int = 60) -> float:
    """The least exponent in [low, high] that is good, given that every larger one is."""
    if good(low):
        return low
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def mixture(totals: dict, target_entropy: float | None = None, most_repeats: float | None = None, budget: float | None = None) -> tuple[float, dict, dict]:
    """Exponent, weights and token budgets of sources with the given token totals.

    With a target entropy (in nats, at most ln of the number of sources) the exponent is the largest that reaches it;
    with a repetition limit it is at least what keeps budget/total of every source within the limit. Without a budget
    the budget is the least at which every source is taken once or more."""
    held = {k: float(v) for k, v in totals.items() if v > 0}
    if not held:
        return 1.0, {k: 0.0 for k in totals}, {k: 0 for k in totals}
    whole = sum(held.values())
    shares = {k: v / whole for k, v in held.items()}

    def size(w: dict) -> float:
        return budget if budget is not None else max(held[k] / w[k] for k in held)

    def within(a: float) -> bool:
        w = weights_at(shares, a)
        return most_repeats is None or max(w[k] * size(w) / held[k] for k in held) <= most_repeats * (1 + 1e-12)

    exponent = 0.0
    if target_entropy is not None and entropy(weights_at(shares, 0.0)) > target_entropy:
        exponent = bisect(lambda a: entropy(weights_at(shares, a)) <= target_entropy, 0.0, 64.0)
    if not within(exponent):
        # a larger exponent repeats small sources less; at 1.0 all are repeated alike
        exponent = bisect(within, exponent, 1.0) if exponent < 1 and within(1.0) else None
    if exponent is None:
        raise ValueError(f"no exponent keeps every source within {most_repeats} repeats of its {whole:.0f} tokens at a budget of {budget}")
    w = weights_at(shares, exponent)
    if target_entropy is not None and most_repeats is not None and entropy(w) < min(target_entropy, entropy(weights_at(shares, 0.0))) - 1e-6:
        raise ValueError(f"within {most_repeats} repeats the entropy reaches {entropy(w):.4f} only, not {target_entropy}")
    total = size(w)
    return exponent, {k: w.get(k, 0.0) for k in totals}, {k: round(w[k] * total) if k in w else 0 for k in totals}


def _order(*cols: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def plan(narrow: DataFrame, seed: int = 8, **target: float) -> DataFrame:
    """One row for each source of narrow (source, key, tie, size): whole epochs and the cut, the place in the last
    permutation up to which rows are taken once more (null: none).

    The order has three levels: blocks, parts of the block that the budget's end falls in, and the rows of such a part,
    a millionth of the source. Only totals of the first two are ordered as a whole. The driver gets one row a source."""
    spark = narrow.sparkSession
    dealt = narrow.withColumns(_places("key", "tie", seed))
    sums = staged(dealt.groupBy("source", "block").agg(F.sum("size").alias("held")), "mixing-blocks")
    totals = {r["source"]: r["t"] for r in sums.groupBy("source").agg(F.sum("held").alias("t")).collect()}
    _, _, budgets = mixture(totals, **target)
    told = [(k, int(budgets[k] // v) if v else 1, int(budgets[k] % v) if v else 0) for k, v in totals.items()]
    room = spark.createDataFrame(told, "source string, epochs long, room long")
    turns = _turns(seed)

    def descend(held: DataFrame, room: DataFrame, at: str) -> DataFrame:
        """The unit of each source in which its room ends: its place in the order, and the room left for it."""
        run = F.sum("held").over(W.partitionBy("source").orderBy("turn", at).rowsBetween(W.unboundedPreceding, 0))
        ranked = held.join(F.broadcast(room), "source").withColumn("turn", turns[at]).withColumn("after", run)
        return ranked.where("after > room and after - held <= room").groupBy("source").agg(F.min_by(F.struct("epochs", (F.col("room") - F.col("after") + F.col("held")).alias("room"), *[c for c in ("at1", "block") if c in held.columns and c != at], F.col("turn").alias("at1" if at == "block" else "at2"), at), F.struct("turn", at)).alias("x")).select("source", "x.*")

    one = descend(sums, room, "block")
    parts = dealt.join(F.broadcast(one), ["source", "block"]).groupBy("source", "block", "at1", "part").agg(F.sum("size").alias("held"))
    two = descend(parts, one.select("source", "epochs", "room"), "part")
    run = F.sum("size").over(W.partitionBy("source").orderBy("turn", "key", "tie"))
    rows = dealt.join(F.broadcast(two), ["source", "block", "part"]).withColumn("turn", turns["row"]).withColumn("after", run)
    last = rows.where("after <= room").groupBy("source").agg(F.max(F.struct("turn", "key", "tie")).alias("z"))
    least = F.struct(F.lit(-(2**63)).cast("long").alias("turn"), F.lit(None).cast(narrow.schema["key"].dataType).alias("key"), F.lit(None).cast("long").alias("tie"))
    cut = two.join(F.broadcast(last), "source", "left").select("source", F.struct("at1", "block", "at2", "part", F.coalesce("z", least).alias("z")).alias("cut"))
    return staged(room.select("source", "epochs").join(F.broadcast(cut), "source", "left"), "mixing-plan")


def _places(key: str, tie: str, seed: int) -> dict[str, Column]:
    """The block of a row and its part of the block."""
    deal = _order(key, tie, seed=seed)
    return {"block": F.pmod(deal, F.lit(BLOCKS)).cast("int"), "part": F.pmod(F.shiftright(deal, 20), F.lit(BLOCKS)).cast("int")}


def _turns(seed: int) -> dict[str, Column]:
    """Places in the permutation of an epoch, at each level."""
    return {"block": _order("source", "block", "epochs", seed=seed + 1), "part": _order("source", "block", "part", "epochs", seed=seed + 2), "row": _order("key", "tie", "epochs", seed=seed + 3)}


def copies(rows: DataFrame, plan: DataFrame, seed: int = 8) -> DataFrame:
    """rows (source, key, tie, ...) with block and copies: how often each row is taken. Rows are not shuffled: the plan
    has a row for each source, as many as the driver has just held."""
    placed = rows.withColumns(_places("key", "tie", seed)).join(F.broadcast(plan), "source")
    turns = _turns(seed)
    place = F.struct(turns["block"].alias("at1"), "block", turns["part"].alias("at2"), "part", F.struct(turns["row"].alias("turn"), "key", "tie").alias("z"))
    more = F.col("cut").isNotNull() & (place <= F.col("cut"))
    return placed.withColumn("copies", F.col("epochs") + more.cast("long")).drop("part", "epochs", "cut")


def _narrow(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> list[Column]:
    return [F.coalesce(F.col(source).cast("string"), F.lit("\0null")).alias("source"), F.col(key).alias("key"), F.xxhash64(text).alias("tie")]


def report(docs: DataFrame, **target: float) -> DataFrame:
    """Per row: doc_id, source, n_tokens, block and how often it is taken."""
    rows = staged(docs.select(*_narrow(docs), tokens().alias("size"), F.col("source").alias("named")), "mixing-rows")
    return copies(rows, plan(rows, **target)).select(F.col("key").alias("doc_id"), F.col("named").alias("source"), F.col("size").alias("n_tokens"), "block", "copies")


def mixed(docs: DataFrame, **target: float) -> DataFrame:
    """docs with every row as often as the mixture takes it."""
    found = plan(staged(docs.select(*_narrow(docs), tokens().alias("size")), "mixing-rows"), **target)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_narrow(docs))
    taken = copies(rows, found).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: Documents of the smallest source are taken twice at most, all others less often, and each at least once.
MOST_REPEATS = 2.0


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), most_repeats=MOST_REPEATS)
