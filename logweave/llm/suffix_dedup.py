"""Suffix-array dedup (operator 6): bytes covered by a 50-byte string that also starts in an earlier document.

Shards are parts of scan splits. A document's windows of LENGTH bytes can repeat elsewhere only if the GRAM-byte piece of
least hash in the window (its anchor) does, so a first pass finds the anchors that two documents share, and only text
around those goes on. Each shard builds the suffix array of that text by Larsson-Sadakane refinement in numpy and
the common prefixes by Kasai's rule (in the form that compares at irreducible places and counts down in between).
Neighbours with 50 common bytes form the classes of equal strings; a document that is not the class's first in the shard
is covered there. What stays first in its shard goes, by its anchor, to a cross-shard task. That task sorts units of
bounded size in the same way and merges their sorted strings by binary search; so a passage in a third of all documents
reaches it once for each shard at most. Copies of whole texts are settled by their digest beforehand.

What a pass finds for the rows of an input file is written to the shared folder under the file's label and read there by
the tasks of the next pass, so the texts themselves are never shuffled.

Null texts are empty. Rows without doc_id come after all others but remove nothing and have nothing removed. Rows that
repeat a doc_id are one document to the rule, each with its own result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import mix, packed, scratch, slices, staged, table, tidy
from .warc import filesystem

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
SHARD_BYTES, UNIT_BYTES = 1 << 22, 3 << 19
KEY_BITS = 64  # of the numbers sorted with the place in their low bits
STEP = 1 << 16  # bytes hashed at a time, so that the arrays stay in the cache
_B = 0x9E3779B97F4A7C15


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every run of `width` neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(x) - width + 1], out[width - have : len(x) - have + 1]) if have < width else out


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte pieces, by doubling."""
    n = len(data)
    if n < GRAM:
        return np.zeros(0, np.uint64)
    h, have = data.astype(np.uint64) + np.uint64(1), 1
    keep = {}
    while have < GRAM:
        keep[have] = h
        if have * 2 > GRAM:
            break
        h = h[:-have] * np.uint64(pow(_B, have, 2**64)) + h[have:]
        have *= 2
    # GRAM = have + rest, rest a power of two seen before
    rest = GRAM - have
    if rest:
        m = n - GRAM + 1
        h = h[:m] * np.uint64(pow(_B, rest, 2**64)) + keep[rest][have : have + m]
    return mix(h)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pieces, and the places that are the least of some window."""
    h = piece_hashes(data)
    if len(data) < LENGTH:
        return h, np.zeros(0, np.int64)
    least = _sliding(h, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, np.uint64)
    top = _sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum)
    return h, np.flatnonzero(top == h)


def byte_words(data: np.ndarray) -> np.ndarray:
    """At each place and at the end: the next 8 bytes as a big-endian number, zeros behind the end; by doubling."""
    word = np.zeros(len(data) + 8, np.uint64)
    word[: len(data)] = data
    for have in (1, 2, 4):
        word = (word[:-have] << np.uint64(8 * have)) | word[have:]
    return word


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort by the first bytes, then refine only groups still equal, doubling the depth. Each sort is of
    single numbers with the place in their low bits where these fit, which is much faster than a sort of indices."""
    n = len(data)
    kind = np.int32 if n < 1 << 30 else np.int64
    if not n:
        return np.zeros(0, kind)
    place_bits = np.uint64(n.bit_length())
    used = np.bincount(data, minlength=256) > 0
    code = np.cumsum(used).astype(np.uint64)  # of the bytes that occur, in their order; 0 is the end, before every byte
    bits = int(code[-1]).bit_length()
    depth = max(1, min(n, (KEY_BITS - int(place_bits)) // bits))
    wide = np.zeros(n + depth, np.uint64)
    wide[:n] = code[data]
    key = wide[:n].copy()
    for j in range(1, depth):
        key <<= np.uint64(bits)
        key |= wide[j : j + n]
    key <<= place_bits
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    sa = (key & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(kind)
    key >>= place_bits
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key, wide
    rank = np.empty(n + 1, kind)  # 0 is the end
    rank[n] = 0
    begin = np.flatnonzero(new)
    rank[sa] = np.repeat((begin + 1).astype(kind), np.diff(np.append(begin, n)))
    alone = new.copy()
    alone[:-1] &= new[1:]
    open_at = np.flatnonzero(~alone)
    first = new[open_at]
    while len(open_at):
        pos = sa[open_at]  # groups lie together and in order, so only the places within each are sorted
        group = np.cumsum(first).astype(np.uint64) - np.uint64(1)
        ahead = rank[np.minimum(pos + kind(depth), n)].astype(np.uint64)
        if int(group[-1]).bit_length() + 2 * int(place_bits) <= KEY_BITS:
            key = (((group << place_bits) | ahead) << place_bits) | pos.astype(np.uint64)
            key.sort()
            pos = (key & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(kind)
            key >>= place_bits
        else:
            key = (group << place_bits) | ahead
            order = np.argsort(key)
            pos, key = pos[order], key[order]
        sa[open_at] = pos
        first = np.ones(len(pos), bool)
        np.not_equal(key[1:], key[:-1], out=first[1:])
        starts = np.flatnonzero(first)
        rank[pos] = np.repeat((open_at[starts] + 1).astype(kind), np.diff(np.append(starts, len(pos))))
        single = first.copy()
        single[:-1] &= first[1:]
        open_at, first, depth = open_at[~single], first[~single], depth * 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Kasai: lcp[k] of the suffixes sa[k-1] and sa[k]; lcp[0] = 0."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, sa.dtype)
    before[sa[1:]] = sa[:-1]
    same = np.zeros(n, bool)
    same[1:] = (before[1:] > 0) & (data[before[1:] - 1] == data[:-1])
    places = np.flatnonzero(~same)  # elsewhere the prefix is one shorter than a place earlier
    other = before[places].astype(np.int64)
    size = np.zeros(len(places), np.int64)
    word = byte_words(data)
    live = np.flatnonzero(other >= 0)
    a, b = places[live], other[live]
    while len(live):
        unlike = word[a] ^ word[b]
        # rounds to no higher power of two, so the exponent is the place of the first bit that differs
        top = (unlike & ~(unlike >> np.uint64(1))).astype(np.float64)
        some = np.minimum((1086 - (top.view(np.int64) >> 52)) >> 3, 8)
        size[live] += some
        on = (some == 8) & (np.maximum(a, b) + 8 < n)
        live, a, b = live[on], a[on] + 8, b[on] + 8
    size = np.minimum(size, n - np.maximum(places, other))  # zeros behind the end are no bytes
    full = np.repeat(places + size, np.diff(np.append(places, n))) - np.arange(n)
    return np.maximum(full, 0)[sa]


def string_classes(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the valid places: the places in suffix order, and the number of the class of equal strings of each."""
    sa = suffix_array(data)
    group = np.cumsum(common_prefixes(data, sa) < LENGTH)
    good = valid[sa]
    return sa[good], group[good]


def _runs(mask: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of true places; a run also ends where breaks is true."""
    first = mask.copy()
    first[1:] &= ~mask[:-1] | (breaks[1:] if breaks is not None else False)
    last = mask.copy()
    last[:-1] &= ~mask[1:] | (breaks[1:] if breaks is not None else False)
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Files:
    """What a pass has written under the label of an input file; each task keeps the latest label only."""

    def __init__(self, folder: str, columns: tuple[str, ...]):
        self.folder, self.columns, self.held = folder, columns, (None, None)

    def get(self, label: int) -> pa.Table | None:
        if self.held[0] != label:
            fs, path = filesystem(f"{self.folder}/label={label}")
            found = fs.get_file_info(path)
            data = None
            if found.type == pafs.FileType.Directory:
                names = [x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".parquet")]
                parts = [pq.ParquetFile(fs.open_input_file(x)).read(columns=list(self.columns)) for x in names]
                data = pa.concat_tables(parts) if parts else None
            self.held = (label, data)
        return self.held[1]


def _publish(df: DataFrame, folder: str) -> str:
    df.repartition("label").write.partitionBy("label").parquet(folder)
    return folder


def _labelled(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.input_file_name()).alias("label"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(label, ids, bytes, offsets) of the rows with an id, by label and in parts of a shard's size; a longer row alone."""
    labels = batch.column(0).to_numpy(zero_copy_only=False)
    for label in np.unique(labels):
        some = batch.filter(pa.array(labels == label))
        some = some.filter(some.column(1).is_valid())
        data, offsets = packed(some.column(2))
        ids = some.column(1).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets, SHARD_BYTES):
            yield int(label), ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _row_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors that lie in one row, taken in pieces to bound the memory."""
    places, hashes = [], []
    step = STEP
    for at in range(0, max(1, len(data)), step):
        lo, hi = max(0, at - 2 * LENGTH), min(len(data), at + step + 2 * LENGTH)
        h, p = anchors(data[lo:hi])
        p = p[(p + lo >= at) & (p + lo < at + step)]
        places.append(p + lo)
        hashes.append(h[p])
    p, h = np.concatenate(places), np.concatenate(hashes)
    row = np.searchsorted(offsets, p, side="right") - 1
    inside = p + GRAM <= offsets[row + 1]
    return p[inside], h[inside]


def _copies(rows: DataFrame) -> DataFrame:
    """(label, id) of rows whose whole text is that of a smaller id."""
    facts = rows.where("id is not null").select("label", "id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("d"))
    first = facts.groupBy("d").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    return facts.join(first, "d").where("id > first").select("label", "id").distinct()


def _without(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, copies: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if copies is None:
        return ids, data, offsets
    keep = ~np.isin(ids, copies.column(0).to_numpy())
    if keep.all():
        return ids, data, offsets
    size = np.diff(offsets)
    return ids[keep], data[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])])


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (numpy's own hashes them first, which takes longer)."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _key(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash, and its key: bucket and 32 other bits. Keys only choose what to look at."""
    bucket = (h >> np.uint64(32)) % np.uint64(buckets)
    return bucket, (bucket << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _shared_anchors(rows: DataFrame, copies: str, buckets: int, folder: str) -> str:
    """Write, by label, the keys of anchors that lie in two documents or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Files(copies, ("id",))
        for batch in batches:
            out: list[tuple] = []
            for label, *part in _parts(batch):
                ids, data, offsets = _without(*part, lists.get(label))
                p, h = _row_anchors(data, offsets)
                _, key = _key(h, buckets)
                doc = ids[np.searchsorted(offsets, p, side="right") - 1]
                order = np.argsort(key)
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                begin = np.flatnonzero(new)
                many = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin) if len(key) else np.zeros(0, bool)
                key = key[begin]
                if many.any():
                    out.append((2, 0, label, key[many].tobytes()))
                for flag, some in ((0, key[~many]), (1, key[many])):
                    cut = np.searchsorted(some >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                    small = some.astype(np.uint32)
                    out += [(flag, b, label, small[cut[b] : cut[b + 1]].tobytes()) for b in range(buckets) if cut[b] < cut[b + 1]]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["kind", "bucket", "label", "keys"])

    seen = staged(rows.mapInArrow(tidy(scan), "kind int, bucket int, label long, keys binary"), "anchors")

    def shared(group: pa.Table) -> pa.Table:
        kinds, labels = group.column("kind").to_numpy(), group.column("label").to_numpy()
        parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("keys")]
        sizes = [len(x) for x in parts]
        key, kind, label = np.concatenate(parts), np.repeat(kinds, sizes), np.repeat(labels, sizes)
        order = np.argsort(key, kind="stable")
        key, kind, label = key[order], kind[order], label[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        back = np.repeat(size > 1, size) & (kind == 0)
        bucket = np.uint64(group.column("bucket")[0].as_py()) << np.uint64(32)
        found = [(int(x), _distinct(key[back & (label == x)]).astype(np.uint64) | bucket) for x in _distinct(label[back])]
        return pa.table({"label": pa.array([x for x, _ in found], pa.int64()), "keys": pa.array([k.tobytes() for _, k in found], pa.binary())})

    told = seen.where("kind < 2").groupBy("bucket").applyInArrow(shared, "label long, keys binary")
    return _publish(seen.where("kind = 2").select("label", "keys").unionAll(told), folder)


def shard_result(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, shared: np.ndarray, buckets: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """One shard: covered (row, start, end) in it, and runs (bucket, row, start, end) that are first here and go on;
    last the compacted bytes' place of each run, and these bytes."""
    none = np.zeros(0, np.int64)
    p, h = _row_anchors(data, offsets)
    hot = _within(_key(h, buckets)[1], shared)
    if not hot.any():
        return (none, none, none), (none, none, none, none), none, data[:0]
    row = np.searchsorted(offsets, p[hot], side="right") - 1
    lo, hi = np.maximum(p[hot] - SPAN + 1, offsets[row]), np.minimum(p[hot] + LENGTH, offsets[row + 1])
    size = len(data)
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    active = np.cumsum(edge[:-1]) > 0
    starts_row = np.zeros(size, bool)
    starts_row[offsets[:-1][offsets[:-1] < size]] = True
    begin, end = _runs(active, starts_row)
    long = end - begin >= LENGTH
    begin, end = begin[long], end[long]
    if not len(begin):
        return (none, none, none), (none, none, none, none), none, data[:0]
    lens = end - begin
    at = np.concatenate([[0], np.cumsum(lens)])
    source = np.repeat(begin - at[:-1], lens) + np.arange(at[-1])
    text = data[source]
    home = np.repeat(np.searchsorted(offsets, begin, side="right") - 1, lens)  # the row of each place
    valid = np.arange(at[-1]) + LENGTH <= np.repeat(at[1:], lens)
    # the anchor of each window: of its least hash, which every copy of the window has at the same place
    window_hash = np.zeros(at[-1], np.uint64)
    step = STEP
    for a in range(0, at[-1], step):
        part = text[a : min(at[-1], a + step + LENGTH)]
        if len(part) >= LENGTH:
            least = _sliding(piece_hashes(part), SPAN, np.minimum)[:step]
            window_hash[a : a + len(least)] = least
    turn = np.ones(len(window_hash), bool)
    turn[1:] = window_hash[1:] != window_hash[:-1]
    turns = np.flatnonzero(turn)
    few, key = _key(window_hash[turns], buckets)
    spread = np.diff(np.append(turns, len(window_hash)))
    bucket = np.repeat(few, spread)
    valid &= np.repeat(_within(key, shared), spread)
    if not valid.any():
        return (none, none, none), (none, none, none, none), none, data[:0]
    pos, group = string_classes(text, valid)
    doc = ids[home[pos]]
    new = np.ones(len(pos), bool)
    new[1:] = group[1:] != group[:-1]
    first = np.repeat(np.minimum.reduceat(doc, np.flatnonzero(new)), np.diff(np.append(np.flatnonzero(new), len(pos))))
    later = np.zeros(len(text), bool)
    later[pos[doc > first]] = True
    region = np.zeros(len(text), bool)
    region[at[:-1]] = True
    a, b = _runs(later, region)
    where, r = source[a], home[a]
    covered = (r, where - offsets[r], source[b - 1] + LENGTH - offsets[r])
    stays = np.zeros(len(text), bool)
    stays[pos[doc == first]] = True
    change = region.copy()
    change[1:] |= bucket[1:] != bucket[:-1]
    a, b = _runs(stays, change)
    where, r = source[a], home[a]
    return covered, (bucket[a].astype(np.int64), r, where - offsets[r], source[b - 1] + LENGTH - offsets[r]), a, text


_FOUND = "label long, id long, lo int, hi int"


def _found(label: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict:
    return {"label": pa.array(label, pa.int64()), "id": pa.array(ids, pa.int64()), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))}


def _within_shards(rows: DataFrame, copies: str, keys: str, buckets: int) -> DataFrame:
    """Written rows: what is covered within a shard (kind 0), and by bucket what goes on across shards (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, known = Files(copies, ("id",)), Files(keys, ("keys",))
        held: tuple = (None, None)
        for batch in batches:
            for label, *part in _parts(batch):
                if held[0] != label:
                    found = known.get(label)
                    blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in found.column(0)] if found is not None else []
                    held = (label, _distinct(np.concatenate(blobs)) if blobs else np.zeros(0, np.uint64))
                ids, data, offsets = _without(*part, lists.get(label))
                (r, lo, hi), (bucket, row, start, end), at, text = shard_result(ids, data, offsets, held[1], buckets)
                out = [(0, 0, label, *(x.tobytes() for x in (ids[r], lo.astype(np.int32), hi.astype(np.int32))), b"")] if len(r) else []
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)):
                    some = order[cut[b] : cut[b + 1]]
                    size = end[some] - start[some]
                    take = np.repeat(at[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    out.append((1, int(b), label, ids[row[some]].tobytes(), start[some].astype(np.int32).tobytes(), end[some].astype(np.int32).tobytes(), text[take].tobytes()))
                columns = list(zip(*out, strict=True)) if out else [()] * 7
                types = (pa.int32(), pa.int32(), pa.int64(), *(pa.binary(),) * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "bucket", "label", "ids", "lo", "hi", "bytes"])

    return staged(rows.mapInArrow(tidy(run), "kind int, bucket int, label long, ids binary, lo binary, hi binary, bytes binary"), "shards")


def _words(data: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Strings of LENGTH bytes as rows of big-endian words, in the same order as the bytes."""
    word = byte_words(data)
    out = np.empty((len(pos), -(-LENGTH // 8)), np.uint64)
    for j in range(out.shape[1]):
        out[:, j] = word[pos + 8 * j]
    if LENGTH % 8:
        out[:, -1] &= ~np.uint64(0) << np.uint64(64 - 8 * (LENGTH % 8))
    return out


def search(table_words: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of rows in sorted distinct rows: the place of the first not less, and whether it is equal."""
    lo = np.searchsorted(table_words[:, 0], wanted[:, 0], side="left")
    hi = np.searchsorted(table_words[:, 0], wanted[:, 0], side="right")
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        less, tie = np.zeros(len(live), bool), np.ones(len(live), bool)
        for j in range(table_words.shape[1]):
            a, b = table_words[mid, j], wanted[live, j]
            less |= tie & (a < b)
            tie &= a == b
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    inside = lo < len(table_words)
    equal = inside.copy()
    equal[inside] = (table_words[lo[inside]] == wanted[inside]).all(axis=1)
    return lo, equal


def across(units: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """units: (bytes, run bounds, document of each run). For each byte place: whether its string is in a smaller document."""
    sorted_units = []
    for data, bounds, docs in units:
        size = np.diff(bounds)
        valid = np.arange(len(data)) + LENGTH <= np.repeat(bounds[1:], size)
        pos, group = string_classes(data, valid)
        new = np.ones(len(pos), bool)
        new[1:] = group[1:] != group[:-1]
        begin = np.flatnonzero(new)
        doc = np.repeat(docs, size)[pos]
        sorted_units.append((pos, np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(pos)))), doc, np.minimum.reduceat(doc, begin) if len(begin) else doc, pos[begin]))
    if len(units) > 1:  # merge the sorted distinct strings, then look every one up
        words = [_words(data, s[4]) for (data, _, _), s in zip(units, sorted_units, strict=True)]
        merged, least = words[0], sorted_units[0][3].copy()
        for w, s in zip(words[1:], sorted_units[1:], strict=True):
            at, equal = search(merged, w)
            np.minimum.at(least, at[equal], s[3][equal])
            merged, least = np.insert(merged, at[~equal], w[~equal], axis=0), np.insert(least, at[~equal], s[3][~equal])
        sorted_units = [(pos, cls, doc, least[search(merged, w)[0]], head) for (pos, cls, doc, _, head), w in zip(sorted_units, words, strict=True)]
    out = []
    for (data, _, _), (pos, cls, doc, first, _) in zip(units, sorted_units, strict=True):
        later = np.zeros(len(data), bool)
        if len(pos):
            later[pos[doc > first[cls]]] = True
        out.append(later)
    return out


def _merge_bucket(group: pa.Table) -> pa.Table:
    labels, starts, docs, sizes, parts = [], [], [], [], []
    for label, ids, lo, hi, raw in zip(*(group.column(c) for c in ("label", "ids", "lo", "hi", "bytes")), strict=True):
        i, a, b = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(lo.as_buffer(), np.int32), np.frombuffer(hi.as_buffer(), np.int32)
        labels.append(np.full(len(i), label.as_py(), np.int64))
        docs.append(i)
        starts.append(a)
        sizes.append((b - a).astype(np.int64))
        parts.append(np.frombuffer(raw.as_buffer(), np.uint8))
    label, doc, start, size, data = map(np.concatenate, (labels, docs, starts, sizes, parts))
    bounds = np.concatenate([[0], np.cumsum(size)])
    # runs of the same bytes, one from each shard mostly, are sorted once, for the first document that has them
    raw, seen = data.tobytes(), {}
    same = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), np.int64, len(size))
    first = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(first, same, doc)
    one = np.fromiter(map(len, seen), np.int64, len(seen))
    text, edges = np.frombuffer(b"".join(seen), np.uint8), np.concatenate([[0], np.cumsum(one)])
    del raw, seen
    cuts = list(slices(edges, UNIT_BYTES))
    units = [(text[edges[a] : edges[b]], edges[a : b + 1] - edges[a], first[a:b]) for a, b in cuts]
    later = np.concatenate(across(units))
    edge = np.zeros(len(later), bool)
    edge[edges[:-1]] = True
    x, y = _runs(later, edge)
    run = np.searchsorted(edges, x, side="right") - 1
    # covered parts of each text hold for all its runs; a run of a later document than the first is covered as a whole
    whole = doc > first[same]
    order = np.argsort(same, kind="stable")
    order = order[~whole[order]]
    low, high = np.searchsorted(same[order], run, "left"), np.searchsorted(same[order], run, "right")
    many = high - low
    pick = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    lo = start[pick] + np.repeat(x - edges[run], many)
    hi = lo + np.repeat(y - x, many) + LENGTH - 1
    ids = (label[whole], doc[whole], start[whole], start[whole] + size[whole])
    return pa.table(_found(*(np.concatenate(c) for c in zip(ids, (label[pick], doc[pick], lo, hi), strict=True))))


def _union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]


def covered_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str]:
    """Labelled rows, and the folders with the copies and the covered spans of each label."""
    spark = docs.sparkSession
    rows = _labelled(docs, key, text)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(1 << 20, -(-total // SHARD_BYTES)))
    copies = _publish(_copies(rows), scratch(spark, "copies"))
    keys = _shared_anchors(rows, copies, buckets, scratch(spark, "keys"))
    parts = _within_shards(rows, copies, keys, buckets)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, ids, lo, hi in zip(*batch.columns, strict=True):
                i = np.frombuffer(ids.as_buffer(), np.int64)
                yield pa.RecordBatch.from_pydict(_found(np.full(len(i), label.as_py()), i, np.frombuffer(lo.as_buffer(), np.int32), np.frombuffer(hi.as_buffer(), np.int32)))

    local = parts.where("kind = 0").select("label", "ids", "lo", "hi").mapInArrow(tidy(unpack), _FOUND)
    cross = parts.where("kind = 1").groupBy("bucket").applyInArrow(_merge_bucket, _FOUND)
    return rows, copies, _publish(local.unionAll(cross), scratch(spark, "spans"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, bytes, removed bytes, removed spans, and the remaining bytes."""
    rows, copies, spans = covered_spans(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, parts = Files(copies, ("id",)), Files(spans, ("id", "lo", "hi"))
        held: tuple = (None,)
        for batch in batches:
            out: list[tuple] = []
            for label, one, value in zip(*batch.columns, strict=True):
                label, one, raw = label.as_py(), one.as_py(), value.as_buffer()
                if held[0] != label:
                    t, c = parts.get(label), whole.get(label)
                    ids, lo, hi = (x.to_numpy() for x in t.columns) if t is not None else (np.zeros(0, np.int64),) * 3
                    order = np.argsort(ids, kind="stable")
                    held = (label, ids[order], lo[order], hi[order], frozenset(c.column(0).to_pylist()) if c is not None else frozenset())
                size = len(raw)
                if one is not None and one in held[4]:
                    out.append((one, size, size if size >= LENGTH else 0, int(size >= LENGTH), b"" if size >= LENGTH else raw.to_pybytes()))
                    continue
                a, b = (np.searchsorted(held[1], one, side) for side in ("left", "right")) if one is not None else (0, 0)
                if a == b:
                    out.append((one, size, 0, 0, raw.to_pybytes()))
                    continue
                lo, hi = _union(held[2][a:b], held[3][a:b])
                keep = np.ones(size + 1, np.int8)
                keep[:] = 0
                np.add.at(keep, lo, 1)
                np.add.at(keep, hi, -1)
                gone = np.cumsum(keep[:-1]) > 0
                out.append((one, size, int((hi - lo).sum()), len(lo), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(tidy(run), "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", key)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
