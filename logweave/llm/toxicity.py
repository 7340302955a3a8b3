"""Toxicity (operator 7): gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon, lexicon words near a second-person pronoun,
and rates of capitals, punctuation and obfuscation (signs or digits inside words). The learned lexicon holds words and
word beginnings that mark toxic texts, learned from a bounded sample of training rows (SAMPLE rows, the least hashes of
doc_id, as far as SAMPLE_BYTES of text) by folds, so that no text's features come from its own label.

Null and empty texts have all features zero. Rows that repeat a doc_id are scored each; contradicting labels count as
their larger value. Without toxic or without other labels the score is the share of toxic ones (0 without labels).
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SpanHasher, packed, remainder, seeds, slices, staged, table, tidy, training_rows, word_bounds

SAMPLE = 8000
# Insults and second-person words of the four languages.
INSULTS = (
    "idiot idiots moron morons stupid loser losers pathetic worthless disgusting scum trash clown clowns dumb jerk fool "
    "imbecile creep freak ugly hate shut idiota imbécil estúpido basura payaso asqueroso patético inútil idiote imbécile "
    "stupide minable ordure dégueulasse nul débile abruti dumm dummkopf trottel depp abschaum widerlich erbärmlich versager"
).split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tú ti".split()
PREFIXES = (4, 5, 6, 7, 8)
NEAR, FOLDS = 3, 3
LANES, SAME = 64, 0.8
NAMES = ("fixed", "learned", "weight", "hits", "near_you", "capitals", "shouting", "punctuation", "marks", "obfuscated", "word_size", "log_words")

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 capital, 3 digit, 4 sign, 5 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[b for b in range(33, 127) if _KIND[b] == 0]] = 4


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _word_hash(words: list[str]) -> np.ndarray:
    data, offsets = packed(pa.array(words, pa.large_string()))
    return np.sort(_short(SpanHasher(data)(offsets[:-1], offsets[1:])))


_INSULTS, _YOU = _word_hash(INSULTS), _word_hash(SECOND_PERSON)


def found_in(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted table, and their places in it; a bit map keeps most from the search."""
    hit, place = np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    if len(table) and len(values):
        bits = np.zeros(1 << 16, bool)
        bits[table >> np.uint32(16)] = True
        at = np.flatnonzero(bits[values >> np.uint32(16)])
        where = np.minimum(np.searchsorted(table, values[at]), len(table) - 1)
        good = table[where] == values[at]
        hit[at[good]], place[at[good]] = True, where[good]
    return hit, place


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without signs at their ends."""
    starts, ends = starts.copy(), ends.copy()
    sign = _KIND[data] == 4
    for _ in range(4):
        starts += (starts < ends) & sign[np.minimum(starts, len(data) - 1)]
        ends -= (starts < ends) & sign[np.maximum(ends - 1, 0)]
    return starts, ends


def evidence(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of words and of their beginnings, each with the mask of the words that are long enough."""
    whole, hashed = np.ones(len(starts), bool), SpanHasher(data)
    out = [(_short(hashed(starts, ends)), whole)]
    for n in PREFIXES:
        long = ends - starts > n
        out.append((_short(hashed(starts, np.minimum(starts + n, ends))) ^ np.uint32(n), long))
    return out


@dataclass
class Lexicon:
    """Sorted hashes and their weights, and the number of training rows they come from."""

    keys: np.ndarray
    weights: np.ndarray
    rows: int


def dense(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of features for each row of bytes."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    s0, e0, counts = word_bounds(data, offsets)
    words = np.maximum(counts, 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])

    def per_row(values: np.ndarray, at: np.ndarray = bounds) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[at[1:]] - total[at[:-1]]

    kind = _KIND[data]
    starts, ends = _trimmed(data, s0, e0)
    marks = evidence(data, starts, ends)
    fixed, _ = found_in(marks[0][0], _INSULTS)
    weight = np.zeros(len(starts))
    for h, use in marks:
        hit, place = found_in(h, lexicon.keys)
        hit &= use
        weight[hit] = np.maximum(weight[hit], lexicon.weights[place[hit]])
    learned = weight > 0
    you, _ = found_in(marks[0][0], _YOU)
    row = np.repeat(np.arange(n), counts)
    any_hit = fixed | learned
    near = np.zeros(len(starts), bool)
    for d in range(1, NEAR + 1):
        same = row[d:] == row[:-d]
        near[d:] |= you[:-d] & same
        near[:-d] |= you[d:] & same
    size = np.maximum(np.diff(offsets), 1)
    capital = per_row(kind == 2, offsets)
    letters = np.maximum(per_row((kind == 1) | (kind == 2) | (kind == 5), offsets), 1)
    caps = np.concatenate([[0], np.cumsum(kind == 2)])
    lows = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 5))])
    odd = np.concatenate([[0], np.cumsum((kind == 3) | (kind == 4))])
    plain = lows + caps
    inside = lambda c: c[ends] - c[starts]
    out[:, 0] = per_row(fixed) / words
    out[:, 1] = per_row(learned) / words
    out[:, 2] = per_row(weight) / words
    out[:, 3] = np.log1p(per_row(any_hit))
    out[:, 4] = per_row(any_hit & near) / words
    out[:, 5] = capital / letters
    out[:, 6] = per_row((inside(caps) >= 3) & (inside(lows) == 0)) / words
    out[:, 7] = per_row(kind == 4, offsets) / size
    out[:, 8] = per_row((data == 33) | (data == 63), offsets) / size
    out[:, 9] = per_row((inside(odd) > 0) & (inside(plain) > 0)) / words
    out[:, 10] = per_row(ends - starts) / words
    out[:, 11] = np.log1p(counts)
    return out


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each set over LANES permutations, one row for each set."""
    out = np.full((len(sets), LANES), 0xFFFFFFFF, np.uint32)
    full = [i for i, h in enumerate(sets) if len(h)]
    if full:
        h = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k, seed in enumerate(seeds(LANES, 7)):
            out[full, k] = np.minimum.reduceat((h ^ _short(seed)) * (_short(seed << np.uint64(32)) | np.uint32(1)), starts)
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes have a Jaccard similarity of SAME or more; empty ones are equal."""
    if min(len(a), len(b)) < SAME * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SAME * (len(a) + len(b) - both)


def one_each(rows: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
    """rows without those that are near copies of an earlier row kept, of the same label. Sets that agree in half of the
    lanes are compared; two of similarity SAME are, but for a chance under 1e-8."""
    minima, y = _minima([h for h, _ in rows]), np.array([y for _, y in rows], np.int64)
    kept: dict[int, list[int]] = {label: [] for label in np.unique(y).tolist()}
    held = {label: np.empty((int((y == label).sum()), LANES), np.uint32) for label in kept}
    for i, (h, label) in enumerate(rows):
        same = kept[label]
        near = np.flatnonzero((held[label][: len(same)] == minima[i]).sum(axis=1) >= LANES // 2)
        if not any(_alike(rows[same[j]][0], h) for j in near):
            held[label][len(same)] = minima[i]
            same.append(i)
    return [rows[i] for i in sorted(i for some in kept.values() for i in some)]


def learn_lexicon(rows: list[tuple[np.ndarray, int]], least: float = 0.01, ratio: float = 8.0) -> Lexicon:
    """rows: distinct evidence hashes of a document and its label; keeps what is `ratio` times as common in toxic ones and
    lies in the share `least` of them, in 3 or more. Near copies count once, lest their rare words become evidence."""
    rows = one_each(rows)
    toxic = [h for h, y in rows if y]
    other = [h for h, y in rows if not y]
    if not toxic or not other:
        return Lexicon(np.zeros(0, np.uint32), np.zeros(0), len(rows))
    least = max(3, round(least * len(toxic)))
    keys, many = np.unique(np.concatenate(toxic), return_counts=True)
    keys, many = keys[many >= least], many[many >= least]
    base_keys, base = np.unique(np.concatenate(other), return_counts=True)
    at = np.minimum(np.searchsorted(base_keys, keys), len(base_keys) - 1)
    base = np.where(base_keys[at] == keys, base[at], 0)
    gain = ((many + 0.5) / (len(toxic) + 1)) / ((base + 0.5) / (len(other) + 1))
    good = (gain >= ratio) & (many >= 0.8 * (many + base))
    return Lexicon(keys[good], np.log(gain[good]), len(rows))


@dataclass
class Trees:
    """Boosted trees of fixed depth over binned features."""

    edges: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - (2**depth - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Logistic boosting with histograms over quantile bins."""
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p0 / (1 - p0)))
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    inner, features, cuts, leaves = 2**depth - 1, [], [], []
    margin = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf, bins)
            for j in range(x.shape[1]) if len(at) > 10 else ():
                gs = np.cumsum(np.bincount(binned[at, j], g[at], bins))[:-1]
                hs = np.cumsum(np.bincount(binned[at, j], h[at], bins))[:-1]
                G, H = g[at].sum(), h[at].sum()
                gain = gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge)
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (gain[b], j, edges[j, b], b)
            feature[k], cut[k] = best[1], best[2]
            node[at] = 2 * k + 1 + (binned[at, best[1]] > best[3])
        leaf = np.zeros(inner + 1)
        where = node - inner
        leaf -= rate * np.bincount(where, g, inner + 1) / (np.bincount(where, h, inner + 1) + ridge)
        margin += leaf[where]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(edges, np.array(features), np.array(cuts), np.array(leaves), base)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising levels and the margins from which they hold."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first margin
    for v, t in zip(x[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(v)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
    # smoothing by a tenth of a row draws small pools towards a half; pooling is kept by never letting a level fall
    return np.array([b[2] for b in blocks]), np.maximum.accumulate(np.array([(b[0] + 0.5 * 0.1) / (b[1] + 0.1) for b in blocks]))


@dataclass
class Toxicity:
    lexicon: Lexicon
    trees: Trees | None
    steps: np.ndarray
    levels: np.ndarray
    flat: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.flat)
        margin = self.trees.margin(dense(data, offsets, self.lexicon))
        return np.clip(np.interp(margin, self.steps, self.levels), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", most: int = SAMPLE) -> Toxicity:
    """Train on at most `most` labelled rows. The features of each fold come from a lexicon of the other folds, and each
    fold is calibrated on the margins of trees that have not seen it; the final lexicon and trees see all."""
    rows = training_rows(docs, labels, label, held_out, most)
    # equal texts are one row, of the least doc_id, toxic if any of them is
    sample = staged(rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")).select("doc_id", "text", "y"), "sample")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                d = data[offsets[i] : offsets[i + 1]]
                s, e, _ = word_bounds(d, np.array([0, len(d)]))
                if len(d):
                    s, e = _trimmed(d, s, e)
                marks = [h[use & (e > s)] for h, use in evidence(d, s, e)]
                out.append(np.unique(np.concatenate(marks)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "y", "hashes"])

    marked = [(r["doc_id"], np.frombuffer(r["hashes"], np.uint32), r["y"]) for r in sample.mapInArrow(tidy(hashes), f"doc_id {kind}, y int, hashes binary").collect()]
    marked.sort(key=lambda r: (r[0], r[1].tobytes()))
    fold_of = lambda key: zlib.crc32(str(key).encode()) // 16 % FOLDS
    folds = [fold_of(k) for k, _, _ in marked]
    lexicons = [learn_lexicon([(h, y) for (_, h, y), f in zip(marked, folds, strict=True) if f != k]) for k in range(FOLDS)]
    final = learn_lexicon([(h, y) for _, h, y in marked])
    flat = float(np.mean([y for _, _, y in marked])) if marked else 0.0
    del marked

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            fold = np.array([fold_of(k) for k in batch.column(0).to_pylist()], np.int64)
            x = np.zeros((batch.num_rows, len(NAMES)))
            for a, b in slices(offsets, 1 << 18):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for k in np.unique(fold[a:b]):
                    x[a:b][fold[a:b] == k] = dense(part, at, lexicons[k])[fold[a:b] == k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = sorted(sample.mapInArrow(tidy(values), f"doc_id {kind}, y int, x array<double>").collect(), key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Toxicity(final, None, np.zeros(0), np.zeros(0), flat)
    x, fold = np.array([r["x"] for r in rows]), np.array([fold_of(r["doc_id"]) for r in rows])
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            margin[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    steps, levels = isotonic(margin, y)
    return Toxicity(final, boost(x, y), steps, levels, flat)


def score(docs: DataFrame, model: Toxicity, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(2))
            out = np.empty(batch.num_rows)
            for a, b in slices(offsets, 1 << 19):
                out[a:b] = model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """docs without those scored at the threshold or more; all columns stay."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(batch.schema.get_field_index("text")))
            keep = np.empty(batch.num_rows, bool)
            for a, b in slices(offsets, 1 << 19):
                keep[a:b] = model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(4) == 2
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), held), held)
