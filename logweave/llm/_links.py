"""Classes of near-duplicate rows from banded signatures: candidates, exact verification, connected components.

Work goes over one representative for each distinct text (as a set of regions: a word shingle, or a shingle and its
occurrence number if counts matter), so copies cost one row each. Rows that agree in a band share a bucket; buckets that
overlap make a cluster, and a cluster's members meet in one task, each with its regions sent once. There every two rows of
fitting sizes that no links join yet are compared exactly, and only a spanning forest of the links leaves the task.

A cluster of more than WORK (rows times regions) is dealt by bucket instead, and a bucket of more than WORK in parts: first
each part alone, together with the bucket's least row, which joins the bulk of a large group; then, of buckets that still
hold several components, the rows outside the largest one against all others, part by part. Rows of one component are
never compared again, so a large group of near copies costs its rows and not their square.

Null and empty texts have no shingles: each is a class of its own. Rows that repeat an id are one document, which has the
links of all its texts. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, mix, packed, shingles, slices, staged, tidy

#: Signer: (region hashes, counts by row) -> one row of band keys for each row.
Signer = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Rows times regions that one task compares at once.
WORK = 100_000_000
#: Words of 64 bits in the map of wanted ids: a broadcast of 4 MB at most.
MAP = 1 << 18
#: Edges in a file of the tables between rounds.
EDGES = 200_000


def regions(h: np.ndarray, counts: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct regions of rows of shingle hashes and their counts: (shingle, occurrence) if weighted, else the shingles."""
    row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    order = np.lexsort((h, row))
    r, e = row[order], h[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
    if not weighted:
        return e[new], np.bincount(r[new], minlength=len(counts))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    return mix(e + mix((np.arange(len(e)) - begin).astype(np.uint64) + np.uint64(1))), counts


def _read(docs: DataFrame, key: str, text: str, words: int, weighted: bool, schema: str, row: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """Per row with a shingle: its id, a 128-bit digest and the number of its regions, and what `row` makes of them."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                h, counts = regions(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words), weighted)
                some = counts > 0
                if not some.any():
                    continue
                many = counts[some]
                starts = np.cumsum(many) - many
                one = np.add.reduceat(mix(h), starts)
                two = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
                keys = batch.column(0).slice(a, b - a).filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([keys, pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(many.astype(np.int64)), *row(h, many)], names)

    return docs.select("id", "text").mapInArrow(tidy(run), schema)


def signed(docs: DataFrame, signer: Signer, key: str, text: str, words: int, weighted: bool) -> DataFrame:
    """(id, d1, d2, size, bands) of the rows (id, text) that have a shingle."""

    def row(h: np.ndarray, many: np.ndarray) -> list[pa.Array]:
        bands = signer(h, many)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.view(np.int64).ravel()))]

    return _read(docs, key, text, words, weighted, "id long, d1 long, d2 long, size long, bands array<long>", row)


def with_regions(docs: DataFrame, key: str, text: str, words: int, weighted: bool) -> DataFrame:
    """(id, d1, d2, size, regions) of the rows (id, text), the regions as 8 bytes each."""

    def row(h: np.ndarray, many: np.ndarray) -> list[pa.Array]:
        offsets = np.concatenate([[0], np.cumsum(many) * 8]).astype(np.int64)
        return [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(h))]).cast(pa.binary())]

    return _read(docs, key, text, words, weighted, "id long, d1 long, d2 long, size long, regions binary", row)


def forest(root: np.ndarray, size: np.ndarray, flat: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (by position) that join rows into components; every two rows of fitting sizes and different components are
    compared. root: a component number for each row, rows of one number count as joined; flat: the rows' regions."""
    order = np.argsort(size, kind="stable")
    begin = (np.cumsum(size) - size)[order]
    size, root = size[order], root[order].copy()
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(flat))
    _, flat, often = np.unique(flat[at], return_inverse=True, return_counts=True)
    # regions of one row only can't be shared
    keep = often[flat] > 1
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])]
    flat = flat[keep]
    marked, out = np.zeros(len(often), bool), []
    low = np.searchsorted(size, np.ceil(size * threshold - 1e-6), side="left")
    for i in range(1, len(size)):
        own = flat[ends[i] : ends[i + 1]]
        other = np.flatnonzero(root[low[i] : i] != root[i]) + low[i]
        if not len(other) or not len(own):
            continue
        marked[own] = True
        if len(other) * 2 > i - low[i]:
            shared = np.diff(np.concatenate([[0], np.cumsum(marked[flat[ends[low[i]] : ends[i]]])])[ends[low[i] : i + 1] - ends[low[i]]])[other - low[i]]
        else:
            many = ends[other + 1] - ends[other]
            stops = np.cumsum(many)
            picked = np.repeat(ends[other] - (stops - many), many) + np.arange(stops[-1])
            shared = np.diff(np.concatenate([[0], np.cumsum(marked[flat[picked]])])[np.concatenate([[0], stops])])
        marked[own] = False
        for j in other[shared >= threshold * (size[i] + size[other] - shared)].tolist():
            if root[j] != root[i]:
                out.append((int(order[j]), int(order[i])))
                root[root == root[j]] = root[i]
    return out


def near(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with a column near: false only of rows whose id is none of the ids, by a bit map of their hashes of MAP words at
    most. What it lets through has still to be joined; what it tells apart needs no shuffle."""
    word, bit = F.expr(f"pmod(xxhash64(id), {MAP})").alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(id), 32), 64) as int))").alias("bit")
    bits = ids.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False)).alias("near")
    return docs.select("*", word, bit).join(F.broadcast(bits), "word", "left").select(*docs.columns, hit)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with none of the ids."""
    told = near(docs, ids)
    rest = told.where("near").join(ids.hint("merge"), "id", "left_anti").select(*docs.columns)
    return told.where("not near").select(*docs.columns).unionAll(rest)


def _links(placed: DataFrame, docs: DataFrame, key: str, text: str, words: int, weighted: bool, threshold: float) -> DataFrame:
    """Links (lo, hi) between the representatives of each group of placed (at, id, d1, d2, root)."""
    ids = placed.select("id").distinct()
    # texts are joined alike at every size: the other side has no bound that a broadcast could rest on
    wanted = near(docs, ids).where("near").join(ids.hint("merge"), "id", "left_semi")
    held = with_regions(wanted, key, text, words, weighted).join(placed.hint("merge"), ["id", "d1", "d2"])
    groups = held.select("at", "id", "root", "size", "regions").repartition("at").sortWithinPartitions("at")

    def close(at: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        t = pa.Table.from_batches(at)
        ids, root, size = (t.column(i).to_numpy() for i in (1, 2, 3))
        if len(ids) > 1 and (root != root[0]).any():
            _, root = np.unique(root, return_inverse=True)
            pairs = forest(root, size, np.frombuffer(b"".join(x.as_py() for x in t.column(4)), np.uint64), threshold)
            if pairs:
                a, b = ids[np.array(pairs).T]
                yield np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            names = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]) if len(names) else [0]
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if waiting and names[a] != now:
                    found += close(waiting)
                    waiting = []
                now = names[a]
                waiting.append(batch.slice(a, b - a))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["lo", "hi"])
        for lo, hi in close(waiting) if waiting else ():
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"])

    return groups.mapInArrow(tidy(run), "lo long, hi long")


def _sum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node of the edges (lo, hi) but the roots; root is the component's smallest node.

    Alternates large-star and small-star steps; groups are only ever aggregated, and each round is a written table."""
    now = staged(edges.where("lo <> hi").select(F.greatest("lo", "hi").alias("hi"), F.least("lo", "hi").alias("lo")).distinct(), label)
    before = _sum(now)
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # a table of its own, so that the join deals both sides itself and splits the edges of a hub
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(down.select("hi", F.col("m").alias("lo"))).distinct()
        new = staged(small.coalesce(2 * before[0] // EDGES + 1), label)
        after = _sum(new)
        discard(now)
        discard(least)
        now = new
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """The same with the roots, each its own root."""
    found = stars(edges, label)
    return found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())


def _parts(rows: Column, size: Column) -> Column:
    """How many parts a group of so many rows and regions is dealt in, so that two parts together are about WORK."""
    return F.ceil(F.sqrt(rows * size / F.lit(float(WORK)))).cast("int")


def classes(docs: DataFrame, signer: Signer, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, weighted: bool = True, label: str = "near") -> DataFrame:
    """(key, class_id) of every row with a key: class_id is the smallest id of the rows joined by links."""
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    how = (key, text, words, weighted)
    rows = staged(signed(texts, signer, *how), f"{label}-signed")
    narrow = rows.select("id", "d1", "d2", "size")
    reps = rows.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.min("size").alias("size"), F.min_by("bands", "id").alias("bands"))
    reps = staged(reps, f"{label}-reps")
    placed = reps.select("id", "d1", "d2", "size", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("bucket", "first")
    active = staged(placed.join(shared, "bucket"), f"{label}-buckets")

    # clusters of buckets that overlap, and the groups that meet in a task
    cluster = components(active.select(F.col("first").alias("lo"), F.col("id").alias("hi")), f"{label}-clusters").select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    members = active.select("id", "d1", "d2", "size").distinct().join(cluster, "id")
    weight = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").cast("double").alias("s"))
    members = members.join(weight, "cluster")
    whole = members.where(F.col("n") * F.col("s") <= WORK).select(F.xxhash64(F.lit(0), "cluster").alias("at"), "id", "d1", "d2", F.col("id").alias("root"))
    wide = members.where(F.col("n") * F.col("s") > WORK).select("id", "d1", "d2")
    hot = active.join(wide, ["id", "d1", "d2"])
    count = hot.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").cast("double").alias("s"))
    hot = hot.join(count.select("bucket", "n", _parts(F.col("n"), F.col("s")).alias("parts")), "bucket")
    hot = staged(hot.select("bucket", "first", "id", "d1", "d2", "size", "n", "parts"), f"{label}-hot")
    part = F.when((F.col("id") == F.col("first")) & (F.col("parts") > 1), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("d1", "d2"), F.col("parts")).cast("int")))
    dealt = hot.select("bucket", "id", "d1", "d2", F.explode(part).alias("part")).select(F.xxhash64(F.lit(1), "bucket", "part").alias("at"), "id", "d1", "d2", F.col("id").alias("root"))
    again = narrow.groupBy("id").agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.min("d2").alias("c"), F.max("d2").alias("d")).where("a <> b or c <> d").select("id")
    same = narrow.join(again, "id").select("id", "d1", "d2").join(reps.select("d1", "d2", F.col("id").alias("rep")), ["d1", "d2"]).select(F.col("rep").alias("lo"), F.col("id").alias("hi")).where("lo <> hi")
    met = staged(whole.unionAll(dealt), f"{label}-met")
    links = staged(_links(met, texts, *how, threshold).unionAll(same), f"{label}-links")
    roots = stars(links, f"{label}-roots")

    # buckets of several parts that still hold several components: what is outside the largest one meets all others
    split = hot.where("parts > 1").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    held = split.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("size").cast("double").alias("s"))
    most = held.groupBy("bucket").agg(F.max_by("root", F.struct("m", "root")).alias("most"), F.sum("m").alias("n"), F.max("m").alias("m"), F.sum("s").alias("s")).where("m < n")
    share = lambda x: F.greatest(F.lit(1), F.ceil(_parts(F.col("n"), F.col("s")) * x / F.col("n"))).cast("int")
    most = most.select("bucket", "most", share(F.col("m")).alias("bulk"), share(F.col("n") - F.col("m")).alias("rest"))
    open_ = split.drop("n", "parts").join(most, "bucket")
    if not open_.isEmpty():
        turn = F.xxhash64("d2", "d1")
        inner = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda j: F.struct(F.least(j, F.pmod(turn, F.col("rest")).cast("int")).alias("a"), F.greatest(j, F.pmod(turn, F.col("rest")).cast("int")).alias("b")))
        outer = F.transform(F.sequence(F.lit(0), F.col("bulk") - 1), lambda j: F.struct(F.pmod(turn, F.col("rest")).cast("int").alias("a"), (-1 - j).alias("b")))
        bulk = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda j: F.struct(j.alias("a"), (-1 - F.pmod(turn, F.col("bulk")).cast("int")).alias("b")))
        met = open_.select("bucket", "id", "d1", "d2", "root", F.explode(F.when(F.col("root") == F.col("most"), bulk).otherwise(F.concat(inner, outer))).alias("p"))
        met = staged(met.select(F.xxhash64(F.lit(2), "bucket", "p.a", "p.b").alias("at"), "id", "d1", "d2", "root"), f"{label}-met")
        more = staged(_links(met, texts, *how, threshold), f"{label}-more")
        roots = stars(links.unionAll(more), f"{label}-roots")

    groups = reps.select("d1", "d2", F.col("id").alias("node")).join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("class_id"))
    known = narrow.select("id", "d1", "d2").join(groups, ["d1", "d2"]).groupBy("id").agg(F.min("class_id").alias("class_id"))
    ids = texts.select("id").distinct()
    return ids.join(known, "id", "left").select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"))
