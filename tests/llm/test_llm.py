"""The ten operators on small fixtures: against brute force, round trips or held-out rows, and with odd rows."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.llm import _common, _links, bpe, dart_minhash, hash_forest, minhash, mixing, secret_scan, subword, suffix_dedup, toxicity, warc

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word and more " * 20_000


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)


def odd(spark):
    """Nulls, an empty and a very long text, repeated rows, and extra columns with names that the code uses inside."""
    rows = docs(spark, [None, "", " \n ", "a b", LONG, "plain words here to read on", "plain words here to read on"])
    rows = rows.unionAll(rows.where("doc_id = 5")).unionAll(docs(spark, ["no id at all here"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    names = ("id", "row", "root", "label", "bucket", "_spans", "_base", "_copies", "_block", "_kept", "k", "t", "y", "size", "clean")
    return rows.withColumns({c: F.lit(1) for c in names})


def words(text):
    return [w.lower() for w in re.split(r"[\t\n\x0b\x0c\r\x1c-\x20]+", text or "") if w]


def shingles(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def likeness(a, b):
    m = sum((a & b).values())
    return m / ((sum(a.values()) + sum(b.values()) - m) or 1)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def families(seed=1):
    r, out = random.Random(seed), []
    for n in (3, 8, 40, 40, 200, 400):
        base = prose(r, n).split()
        out.append(" ".join(base))
        for edits in (0, 1, 2, n // 40, n // 8):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(n)] = "changed%d" % r.randrange(99)
            out.append(" ".join(w))
    return out


# --- 1, 7 ---------------------------------------------------------------------------------------------------------


def labelled(spark, bad):
    r = random.Random(2)
    rows = [(i, i % 3 == 0, prose(r, 60)) for i in range(400)]
    texts = docs(spark, [bad(r, t) if b else t for _, b, t in rows])
    return texts, rows


def test_quality_held_out(spark):
    def junk(r, t):
        return r.choice([t.upper() + "!!", " ".join(w + "$$$" for w in t.split()), " ".join(w for w in t.split()[:9] for _ in range(9))])

    texts, rows = labelled(spark, junk)
    labels = spark.createDataFrame([(i, 0 if b else 1) for i, b, _ in rows], "doc_id bigint, quality int")
    held = _common.remainder(5) == 0
    model = subword.fit(texts, labels, "quality", held)
    got = {r["doc_id"]: r for r in subword.score(texts, model, held).collect()}
    wrong = [i for i, b, _ in rows if got[i]["held_out"] and got[i]["predicted"] != (0 if b else 1)]
    assert len(wrong) <= 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert subword.score(odd(spark), model, held).count() == 9
    empty = subword.fit(texts.limit(0), labels.limit(0), "quality", held)
    assert subword.score(texts.limit(0), empty, held).count() == 0


def test_toxicity_held_out(spark):
    def rude(r, t):
        w = t.split()
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(["you idiot", "zorgalish", "zorgalath"]))
        return " ".join(w)

    texts, rows = labelled(spark, rude)
    labels = spark.createDataFrame([(i, int(b)) for i, b, _ in rows], "doc_id bigint, toxic int")
    held = _common.remainder(4) == 2
    model = toxicity.fit(texts, labels, held)
    got = {r["doc_id"]: r for r in toxicity.score(texts, model, held).collect()}
    wrong = [i for i, b, _ in rows if got[i]["held_out"] and got[i]["predicted"] != int(b)]
    assert len(wrong) <= 4
    assert toxicity.keep_clean(odd(spark), model).columns == odd(spark).columns
    assert toxicity.score(odd(spark), model, held).count() == 9
    none = toxicity.fit(texts, labels.limit(0), held)
    assert {r["score"] for r in toxicity.score(texts, none, held).collect()} == {0.0}


def test_one_class_and_contradicting_labels(spark):
    texts = docs(spark, ["good words", "bad words", "bad words", None])
    held = _common.remainder(5) == 9
    one = spark.createDataFrame([(0, 1), (1, 1)], "doc_id bigint, quality int")
    assert subword.score(texts, subword.fit(texts, one, "quality", held), held).count() == 4
    both = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (0, None), (None, 1)], "doc_id bigint, toxic int")
    rows = {(r["doc_id"], r["y"]) for r in _common.training_rows(texts, both, "toxic", held, 10).collect()}
    assert rows == {(1, 1), (2, 0)}
    assert _common.training_rows(texts, both, "toxic", held, 10, most_bytes=1).count() == 1
    assert toxicity.fit(texts, both, held).flat == 1.0  # equal texts are one row, toxic if any is


def test_quality_scores_equal_a_plain_sum():
    """The score of a text is the mean of its features' numbers, feature by feature."""
    r = np.random.default_rng(12)
    model = subword.Subword(r.normal(size=1 << subword.BITS).astype(np.float32), 0.3)
    texts = ["", " \n", "a", "the the THE cat", "grüße an alle alle", "x" * 40 + " y", "one two three"]
    data, offsets = _common.packed(pa.array(texts, pa.large_string()))
    got = model.scores(data, offsets)
    number = lambda word: int(_common.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), fold=False)[0] >> np.uint64(64 - subword.BITS))

    def gram(part):
        h = 0
        for b in part:
            h = (h * 0x01000193 + int(subword._CODE[b])) % 2**32
        return ((h * 0x9E3779B1 % 2**32 ^ len(part) * 0x85EBCA6B % 2**32) * 0xC2B2AE35 % 2**32) >> (32 - subword.BITS)

    for text, score in zip(texts, got, strict=True):
        parts = text.encode().split()
        ids = [number(w) for w in parts] + [subword.ECHO for a, b in zip(parts, parts[1:], strict=False) if a.lower() == b.lower()]
        for w in parts:
            wide = b" " + w + b" "
            ids += [gram(wide[i : i + n]) for n in subword.GRAMS for i in range(len(wide) - n + 1)]
        mean = float(np.mean(model.weight[ids])) if ids else 0.0
        assert abs(score - 1 / (1 + math.exp(-mean - 0.3))) < 1e-6, text


def test_toxicity_features_and_trees_equal_plain_ones():
    hashes = toxicity._word_hash(["zorg", "blarg"])
    lexicon = toxicity.Lexicon(hashes, np.array([2.0, 3.0]), 9)
    texts = ["", "You IDIOT!! zorg", "a b c d you e f blarg stupid", "SHOUT quiet l33t f*ck ok?", "plain words only"]
    data, offsets = _common.packed(pa.array(texts, pa.large_string()))
    got = toxicity.dense(data, offsets, lexicon)
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    weight = dict(zip(hashes.tolist(), (2.0, 3.0), strict=True))
    for text, row in zip(texts, got, strict=True):
        words = [w.strip(signs) for w in text.split()]
        n, one = max(len(words), 1), [weight.get(int(toxicity._word_hash([w])[0]), 0.0) if w else 0.0 for w in words]
        fixed, you = [w.lower() in toxicity.INSULTS for w in words], [w.lower() in toxicity.SECOND_PERSON for w in words]
        hit = [a or b > 0 for a, b in zip(fixed, one, strict=True)]
        near = [any(you[j] for j in range(max(0, i - 3), min(len(words), i + 4)) if j != i) for i in range(len(words))]
        upper, letters = sum(c.isupper() for c in text), sum(c.isalpha() for c in text)
        shout = sum(sum(c.isupper() for c in w) >= 3 and not any(c.islower() for c in w) for w in words)
        odd = sum(any(c in signs or c.isdigit() for c in w) and any(c.isalpha() for c in w) for w in words)
        want = [sum(fixed) / n, sum(x > 0 for x in one) / n, sum(one) / n, math.log1p(sum(hit)), sum(a and b for a, b in zip(hit, near, strict=True)) / n]
        want += [upper / max(letters, 1), shout / n, sum(c in signs for c in text) / max(len(text), 1), sum(c in "!?" for c in text) / max(len(text), 1), odd / n]
        want += [sum(map(len, words)) / n, math.log1p(len(words) if text else 0)]
        assert np.allclose(row, want if text else 0), text
    r = np.random.default_rng(13)
    x = r.normal(size=(300, 4))
    trees = toxicity.boost(x, (x[:, 0] * x[:, 1] > 0).astype(float), rounds=12)
    for row, margin in zip(x[:40], trees.margin(x[:40]), strict=True):
        total = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += leaf[node - len(f)]
        assert abs(total - margin) < 1e-9
    assert np.mean((trees.margin(x) > 0) == (x[:, 0] * x[:, 1] > 0)) > 0.9


def test_lexicon_merges_only_near_copies():
    r = np.random.default_rng(4)
    common = r.integers(0, 1 << 32, 40, dtype=np.uint32)
    own = lambda n: r.integers(0, 1 << 32, n, dtype=np.uint32)
    rows = [(np.unique(np.concatenate([common, own(40)])), i % 4 == 0) for i in range(300)]  # similarity of a third
    assert len(toxicity.one_each(rows)) == 300 and toxicity.learn_lexicon(rows).rows == 300
    copies = [(np.unique(np.concatenate([rows[0][0][:76], own(4)])), 1) for _ in range(20)]  # of 0.9
    assert len(toxicity.one_each(rows + copies)) == 300
    assert len(toxicity.one_each([*rows, (rows[0][0], 0), (rows[1][0][:60], 0)])) == 302  # another label; similarity 0.75
    assert len(toxicity.one_each([(np.zeros(0, np.uint32), 0)] * 2)) == 1 and toxicity.one_each([]) == []


def test_isotonic_rises():
    r = np.random.default_rng(1)
    x = r.normal(size=300)
    steps, levels = toxicity.isotonic(x, (x + r.normal(size=300) > 0).astype(float))
    assert (np.diff(steps) >= 0).all() and (np.diff(levels) >= 0).all()
    # pools of 99 of 100 and of 1 of 1: smoothing alone would put the second below the first
    steps, levels = toxicity.isotonic(np.array([0.0] * 100 + [1.0]), np.array([0.0] + [1.0] * 100))
    assert len(levels) == 2 and levels[0] <= levels[1]


# --- 2, 10 --------------------------------------------------------------------------------------------------------


def brute_classes(texts, weighted=True):
    s = [shingles(t) if weighted else collections.Counter(set(shingles(t))) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and likeness(s[i], s[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("how", [dart_minhash.near_classes, minhash.near_duplicates])
@pytest.mark.parametrize("work", [_links.WORK, 300])
def test_near_classes_equal_brute_force(spark, how, work, monkeypatch):
    """Clusters whole, dealt by bucket, and buckets dealt in parts give the same classes."""
    monkeypatch.setattr(_links, "WORK", work)
    r = random.Random(21)
    base = prose(r, 60).split()
    # one large group under and over the threshold, and texts that differ in how often they repeat a passage
    group = [" ".join("new%d" % r.randrange(999) if r.random() < p else w for w in base) for p in (0.01, 0.02, 0.03, 0.05) for _ in range(40)]
    again = [" ".join(base[:9] * n) for n in (3, 4, 5, 10, 11, 20)]
    texts = families() + group + again
    got = {x["doc_id"]: x["class_id"] for x in how(docs(spark, texts)).collect()}
    assert got == brute_classes(texts, how is dart_minhash.near_classes)


def test_near_classes_of_repeated_ids(spark):
    """An id with several texts has the links of all of them."""
    r = random.Random(22)
    a, b, c = (prose(r, 40) for _ in range(3))
    rows = [(1, a), (2, b), (5, a + " more"), (5, b), (7, c), (8, c + " more"), (9, c), (9, "unlike")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    assert {x["doc_id"]: x["class_id"] for x in dart_minhash.near_classes(df).collect()} == {1: 1, 2: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_near_classes_of_odd_rows(spark):
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_classes(odd(spark)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    kept = dart_minhash.keep_one(odd(spark))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5]
    assert kept.columns == odd(spark).columns and kept.where("doc_id is null").count() == 1
    assert dart_minhash.near_classes(docs(spark, []).limit(0)).count() == 0


def test_keep_one_of_repeated_ids(spark):
    r = random.Random(15)
    a, b, c, d = (prose(r, 40) for _ in range(4))
    rows = [(1, a), (5, b), (5, c), (5, a + " more"), (7, c), (5, b), (5, d), (9, d + " more"), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).repartition(3)
    got = [(x["doc_id"], x["text"]) for x in dart_minhash.keep_one(df).collect()]
    assert collections.Counter(got) == collections.Counter([(1, a), (5, b), (5, c), (5, d), (9, None), (9, "")])


def test_darts_estimate_weighted_similarity():
    r = random.Random(3)
    a = [r.randrange(2**60) for _ in range(300)]
    b = a[:200] + [r.randrange(2**60) for _ in range(100)] + a[:50]
    h, n = np.array(a + b, np.uint64), np.array([len(a), len(b)])
    s = dart_minhash.signatures(*_links.regions(h, n, True), 512)
    want = likeness(collections.Counter(a), collections.Counter(b))
    assert abs((s[0] == s[1]).mean() - want) < 0.08


def test_components(spark):
    from logweave.llm._links import components

    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (7, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "lo bigint, hi bigint")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 55: 50, 60: 50}


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RUN", 4)
    r = random.Random(5)
    texts = [prose(r, r.randint(0, 80)) + "é😀" * (i % 2) for i in range(23)] + ["", None]
    got = {x["doc_id"]: x for x in minhash.compare_edited(docs(spark, texts)).collect()}
    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        nxt = full[i - 1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        a, b = set(shingles(t)), set(shingles(e))
        want = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i]["near_edited"] - want) < 0.2
        lanes = lambda p: [p[4 * k : 4 * k + 4] for k in range(128)]
        for kind, other, print_ in (("edited", b, got[i]["edited_fingerprint"]), ("next", set(shingles(nxt)), got[i - 1 if i else 24]["fingerprint"])):
            mine, theirs = lanes(got[i]["fingerprint"]), lanes(print_)
            assert got[i][f"near_{kind}"] == np.mean([x == y for x, y in zip(mine, theirs, strict=True)])
            bands = sum(mine[6 * k : 6 * k + 6] == theirs[6 * k : 6 * k + 6] for k in range(21))
            exact = len(a & other) / len(a | other) if a | other else 1.0
            assert got[i][f"bands_{kind}"] == bands and got[i][f"jaccard_{kind}"] == (exact if bands else None)
    assert got[23]["fingerprint"] == got[24]["fingerprint"] == "f" * 512
    assert minhash.compare_edited(odd(spark)).count() == 9
    alone = minhash.compare_edited(docs(spark, ["one text only"])).first()
    assert alone["near_next"] == 1.0
    assert minhash.compare_edited(docs(spark, []).limit(0)).count() == 0


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    big = "x" * 400_000
    pages = [(3, "u", "a" * 200), (1, "u\r\nv", "a" * 200), (2, None, "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", big), (7, "u", big + "é"), (8, "u", ""), (None, "u", "a" * 200)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id bigint, url string, html string, path int")
    index = warc.write_bundles(df, _common.scratch(spark, "test-warc"))
    got = {r["page_id"]: r for r in warc.read_bundles(index).collect()}
    for i, _, html in pages:
        payload = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {3: 1, None: 1}
    at = index.where("page_id = 7").first()
    record = warc.BundleReader(at["path"]).record(at["frame"], at["offset"], at["length"])
    assert record.endswith("é\r\n\r\n".encode()) and b"WARC-Type: response" in record
    assert warc.read_bundles(warc.write_bundles(df.limit(0), _common.scratch(spark, "test-warc"))).count() == 0


def test_warc_of_repeated_ids(spark):
    duckdb = pytest.importorskip("duckdb")
    a, b, c = "a" * 200, "b" * 300, "c" * 150
    pages = [(1, "u", a), (2, "u", b), (5, "u", a), (5, "u", c), (5, "u", b), (5, "u", a), (5, "u", "tiny"), (2, "u", c), (6, "u", c), (None, "u", b), (None, "u", "none else" * 20)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    index = warc.write_bundles(df, _common.scratch(spark, "test-warc"))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert collections.Counter(map(tuple, warc.read_bundles(index).select(*cols).collect())) == collections.Counter(con.execute(warc.OP3_SQL).fetchall())


# --- 4 ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(encoder, library):
    r = random.Random(6)
    letters = "aaabbeethinganionst 's't<|endoftext|> ÉéßΣςİ0123 .,!?-_́ñ漢字😀\n\t\x1c"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a" * 3000, "ab" * 3000, "hello" * 900, "." * 3000, "é" * 900, "x" * 257]
    texts += ["".join(r.choice("aeinthrsou") for _ in range(3000)) for _ in range(5)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == want.ids
        assert encoder.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_streams(encoder, library):
    word = "".join(random.Random(7).choice("abcdehinorst") for _ in range(9000))
    for step in (1, 7, 1000):
        stream, out = bpe.Transducer(encoder.merges, window=300), []
        for at in range(0, len(word) - step, step):
            out += stream.feed(word[at : at + step].encode())
            assert len(stream.held) <= 300 + encoder.merges.lookahead + step
        done = at + step if len(word) > step else 0
        out += stream.finish(word[done:].encode())
        assert out == library.encode(word, add_special_tokens=False).ids


def test_every_word_goes_through_the_transducer(encoder, library):
    """Windows and pieces of every size give the library's ids, and no word but by way of `step`."""
    r = random.Random(23)
    words = ["".join(r.choice("abcdehinorst") for _ in range(n)) for n in (1, 2, 9, 63, 64, 65, 700, 731, 732, 2500)] + ["é" * 500, "hello" * 300]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    raw = [w.encode() for w in words]
    for window in (64, 100, 1024):
        machine, seen = bpe.Transducer(encoder.merges, window), []
        step = machine.step
        machine.step = lambda a, b, c: seen.append(int(b.max())) or step(a, b, c)  # noqa: B023
        assert machine.encode(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])) == want
        assert seen and max(seen) <= window + encoder.merges.lookahead
    small = bpe.Encoder(bpe.vocabulary(), piece=40, window=64)
    text = " ".join(words) + " and 12 more"
    assert small.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_byte_to_text_machine(encoder, library):
    text = "grüße, 漢字 😀 and more"
    ids = encoder.encode(text)
    machine = bpe.TextDecoder(encoder.merges, raw=True)
    got = "".join(machine.feed([i]) for i in ids) + machine.feed([], last=True)
    assert got.replace(" ", "") == text.replace(" ", "")
    for size in (1, 2, 5):
        machine = bpe.TextDecoder(encoder.merges)
        got = "".join(machine.feed(ids[at : at + size]) for at in range(0, len(ids), size)) + machine.feed([], last=True)
        assert got == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, library):
    rows = bpe.token_digests(odd(spark), bpe.vocabulary()).collect()
    assert len(rows) == 9
    for r in rows:
        if r["doc_id"] == 4:
            ids = library.encode(LONG, add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        if r["doc_id"] in (0, 1, 2):
            assert r["n_tokens"] == 0 and r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(docs(spark, ["a b"]), bpe.vocabulary()).first()["ids"] == library.encode("a b", add_special_tokens=False).ids


# --- 5 ------------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(400, 16)) * r.uniform(0.5, 2, size=(400, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [1.0, None] * 8, 0), (403, [float("nan")] * 16, 0), (404, [1.0, 2.0], 0), (None, [1.0] * 16, 0), (7, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, block int")
    got = collections.defaultdict(dict)
    for q in hash_forest.nearest(df, df.where("vec_id % 20 = 0 or vec_id > 399"), 20).collect():
        got[q["query_id"]][q["rank"]] = (q["vec_id"], q["score"])
    assert set(got) == set(range(0, 400, 20))
    hits = []
    for q, found in got.items():
        s = x @ x[q]
        best = [i for i in sorted(range(400), key=lambda i: (-s[i], i)) if i != q][:20]
        assert sorted(found) == list(range(1, 21)) and all(abs(s[v] - sc) < 1e-9 for v, sc in found.values())
        hits.append(len({v for v, _ in found.values()} & set(best)) / 20)
    assert np.mean(hits) >= 0.9
    assert hash_forest.nearest(df.limit(0), df.limit(0)).count() == 0


def brute_nearest(x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[q]
        out[q] = [(i, s[i]) for i in sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:k]]
    return out


@pytest.mark.parametrize("shard", [8192, 40])
def test_nearest_of_small_tables_is_exact(spark, shard, monkeypatch):
    """Few rows, several shards and copies of one vector: every query gets its 20 nearest, or all there are."""
    monkeypatch.setattr(hash_forest, "SHARD_ROWS", shard)
    r = np.random.default_rng(9)
    for n in (1, 2, 5, 21, 30, 100):
        x = r.normal(size=(n, 8))
        x[n // 2 :: 3] = x[0]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        got = collections.defaultdict(list)
        for q in hash_forest.nearest(df, df.where("vec_id % 5 = 0"), 20).orderBy("query_id", "rank").collect():
            got[q["query_id"]].append((q["vec_id"], q["score"]))
        want = brute_nearest(x, range(0, n, 5), 20)
        assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items() if f}


def test_forest_ranks_a_part_of_a_shard():
    r = np.random.default_rng(10)
    x = r.normal(size=(8000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, 8000, 100)
    found = hash_forest.Forest(x, 1.0, hash_forest.directions(32)).candidates(x[asked], asked, int(hash_forest.ENOUGH * 8000))
    best = [{i for i, _ in f} for f in brute_nearest(x, asked.tolist(), 20).values()]
    assert np.mean([len(b & set(f.tolist())) / 20 for b, f in zip(best, found, strict=True)]) >= 0.9
    assert all(len(f) >= hash_forest.ENOUGH * 8000 and q not in f for q, f in zip(asked, found, strict=True))
    assert np.mean([len(f) for f in found]) <= 0.4 * 8000


# --- 6 ------------------------------------------------------------------------------------------------------------


def brute_spans(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        own = {b[k : k + 50] for k in range(len(b) - 49)}
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = [True] * 50
        seen |= own
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def test_suffix_dedup(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 400)
    r = random.Random(9)
    shared = [prose(r, 25) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [prose(r, r.randint(0, 20)), r.choice(shared)[: r.randint(30, 160)], "ñ" * r.randint(0, 40), r.choice(shared)]
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], "", None, "ab" * 60, "ab" * 60, "short", "short", "a" * 49, "a" * 49, "a" * 50, "a" * 51]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffix_dedup.deduplicated(docs(spark, texts).repartition(3)).collect()}
    assert got == brute_spans(texts)


def test_suffix_dedup_of_odd_rows(spark):
    rows = suffix_dedup.deduplicated(odd(spark)).collect()
    assert len(rows) == 9 and all(r["n_removed"] == 0 for r in rows if r["doc_id"] != 4)
    assert suffix_dedup.deduplicated(docs(spark, []).limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(10)
    for n in (1, 2, 9, 60, 300):
        d = np.array([r.choice([0, 1, 255]) for _ in range(n)], np.uint8)
        b, sa = bytes(d), suffix_dedup.suffix_array(d)
        assert list(sa) == sorted(range(n), key=lambda i: b[i:])
        lcp = [0] + [len([1 for k in range(1, n + 1) if b[i : i + k] == b[j : j + k] and max(i, j) + k <= n]) for i, j in zip(sa, sa[1:], strict=False)]
        assert list(suffix_dedup.common_prefixes(d, sa)) == lcp


def test_suffix_array_without_room_for_places(monkeypatch):
    r = random.Random(12)
    texts = [np.array([r.choice(some) for _ in range(n)], np.uint8) for some in ([0], [0, 1, 255], range(256)) for n in (2, 60, 700)]
    whole = [suffix_dedup.suffix_array(d) for d in texts]
    monkeypatch.setattr(suffix_dedup, "KEY_BITS", 12)
    for d, sa in zip(texts, whole, strict=True):
        assert list(suffix_dedup.suffix_array(d)) == list(sa) == sorted(range(len(d)), key=lambda i: bytes(d)[i:])


def test_string_classes_sort_numbers_and_not_indices(monkeypatch):
    """A sort of indices takes several times as long as one of numbers that hold the place; it is left to texts too long for that."""
    r, sort, seen = random.Random(13), np.argsort, []
    parts = [prose(r, 40) for _ in range(200)]
    data = np.frombuffer(" ".join(parts + r.sample(parts, 50)).encode(), np.uint8)
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: seen.append(len(x)) or sort(x, *a, **k))
    pos, group = suffix_dedup.string_classes(data, np.arange(len(data)) + 50 <= len(data))
    assert sum(seen) == 0
    strings = [data[p : p + 50].tobytes() for p in pos]
    assert strings == sorted(strings) and list(group[1:] != group[:-1]) == [a != b for a, b in zip(strings, strings[1:], strict=False)]


def test_units_merge_by_binary_search():
    r = random.Random(11)
    runs = [(prose(r, 12)[:55].ljust(55, "x").encode(), k) for k in range(12)] * 2
    runs = [(t, i) for i, (t, _) in enumerate(runs)]
    unit = lambda some: (np.frombuffer(b"".join(t for t, _ in some), np.uint8), np.cumsum([0] + [len(t) for t, _ in some]), np.array([d for _, d in some]))
    one, two = suffix_dedup.across([unit(runs[:12])])[0], suffix_dedup.across([unit(runs[:7]), unit(runs[7:])])
    assert not one.any() and two[1].reshape(-1, 55)[5:, :6].all() and not two[0].any()


# --- 8 ------------------------------------------------------------------------------------------------------------


def test_mixture():
    totals = {"a": 900, "b": 90, "c": 10}
    a, w, b = mixing.mixture(totals, target_entropy=0.9)
    assert abs(mixing.entropy(w) - 0.9) < 1e-6 and abs(sum(w.values()) - 1) < 1e-9
    a, w, b = mixing.mixture(totals, most_repeats=2.0)
    assert max(b[k] / totals[k] for k in totals) <= 2.001 and min(b[k] / totals[k] for k in totals) >= 0.999
    assert math.isclose(w["b"] / w["a"], (90 / 900) ** a, rel_tol=1e-6)
    with pytest.raises(ValueError):
        mixing.mixture({"a": 900, "b": 100}, most_repeats=2.0, budget=5000)
    with pytest.raises(ValueError):
        mixing.mixture({"a": 900, "b": 100}, most_repeats=1.1, target_entropy=0.69)
    assert mixing.mixture({}) == (1.0, {}, {}) and mixing.mixture({"a": 0})[2] == {"a": 0}


def test_mixing_meets_budgets(spark):
    r = random.Random(12)
    rows = [(i, prose(r, r.randint(1, 30)), "en", "a" if i % 10 < 7 else "b" if i % 10 < 9 else None, 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOC)
    got = mixing.report(df, target_entropy=1.05, budget=9000.0).collect()
    assert len(got) == 600 and all(x["n_tokens"] == len(rows[x["doc_id"]][1].split()) for x in got)
    totals = collections.Counter()
    taken = collections.Counter()
    for x in got:
        totals[x["source"] or "\0null"] += x["n_tokens"]
        taken[x["source"] or "\0null"] += x["n_tokens"] * x["copies"]
    _, _, budgets = mixing.mixture(dict(totals), target_entropy=1.05, budget=9000.0)
    assert all(0 <= budgets[k] - taken[k] <= 30 for k in totals)
    for k in totals:
        times = {x["copies"] for x in got if (x["source"] or "\0null") == k}
        assert max(times) - min(times) <= 1
    # the rows taken once more are those before the budget's end in the order, by brute force
    place = {}
    seen = mixing._places("doc_id", "tie", 8)
    base = df.withColumns({"tie": F.xxhash64("text"), "s": F.coalesce("source", F.lit("\0null"))}).withColumns(seen)
    epochs = F.create_map(*[F.lit(x) for k in totals for x in (k, budgets[k] // totals[k])])
    base = base.select("doc_id", F.col("s").alias("source"), "block", "part", F.col("doc_id").alias("key"), "tie", epochs[F.col("s")].cast("long").alias("epochs"))
    for x in base.withColumns({f"at_{k}": c for k, c in mixing._turns(8).items()}).collect():
        place[x["doc_id"]] = (x["at_block"], x["block"], x["at_part"], x["part"], x["at_row"], x["key"])
    copies = {x["doc_id"]: x["copies"] for x in got}
    for k in totals:
        room = budgets[k] - budgets[k] // totals[k] * totals[k]
        for x in sorted((x for x in got if (x["source"] or "\0null") == k), key=lambda x: place[x["doc_id"]]):
            room -= x["n_tokens"]
            assert copies[x["doc_id"]] == budgets[k] // totals[k] + (room >= 0)
            room = min(room, -1) if room < 0 else room
    again = mixing.mixed(odd(spark), most_repeats=2.0)
    assert again.columns == odd(spark).columns and again.count() >= 9
    assert mixing.report(df.limit(0), most_repeats=2.0).count() == 0


# --- 9 ------------------------------------------------------------------------------------------------------------


def brute_secrets(text):
    text, found = text or "", []
    for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(found)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        v = m[0]
        if any(s < m.end() and m.start() < e for s, _, e in base) or not (re.search("[0-9]", v) and re.search("[A-Za-z]", v) or v.isdigit() or v.isalpha() and not v.isupper() and not v.islower()) or re.search(secret_scan.ALLOWED.removeprefix("(?i)"), v, re.I):
            continue
        limit = next(b for p, b in secret_scan.CLASSES if re.search(p, v))
        best = max(-sum(c / 20 * math.log2(c / 20) for c in collections.Counter(v[i : i + 20]).values()) for i in range(len(v) - 19))
        if best >= limit:
            found.append((m.start(), 3, m.end()))
    join = lambda x: ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(x))
    return [sum(k == j for _, k, _ in base) for j in range(3)], hashlib.sha256(join(base).encode()).hexdigest(), join(found)


def test_secrets_equal_brute_force(spark):
    r = random.Random(13)
    texts = [None, "", 'x Password: "abc123def" and token=short', "é😀 secret = aaaaaa AKIA" + "Z9" * 9 + " " + "0af3" * 8, "key AKIAB deadbeef" * 3, "id 6f9619ff-8b86-d011-b42d-00c04fc964ff", "k=" + "example" * 4 + "1", "api_key=x api-key=yyyyyyyy APIKEY : zzzzzz"]
    alphabet = "abcdef0123456789ABCXYZ+/_=-. :'\"é"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(5, 200))) for _ in range(150)]
    texts += ["token" + "".join(r.choice("=: 'abc123") for _ in range(30)) for _ in range(60)]
    texts += ["x " + "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(r.randint(20, 60))) + " y" for _ in range(60)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(24)) for _ in range(20)] + ["".join(r.choice("0123456789") for _ in range(22)) for _ in range(20)]
    texts += [" ".join("token=%dabcdef" % k for k in range(n)) for n in (255, 256, 257, 600)]
    got = {x["doc_id"]: x for x in secret_scan.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        counts, digest, spans = brute_secrets(t)
        assert ([got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]], got[i]["base_sha256"], got[i]["spans"]) == (counts, digest, spans), t


def test_one_long_candidate(spark):
    """A run of 200,000 characters takes seconds: each step of the window costs the same."""
    r = random.Random(24)
    value = "".join(r.choice(secret_scan.ALPHABET) for _ in range(200_000))
    began = time.time()
    row = secret_scan.scan(docs(spark, [f"é {value} x"])).first()
    assert row["spans"] == "entropy:2:200002" and time.time() - began < 60


def test_redaction(spark):
    df = odd(spark).unionByName(docs(spark, ["a token=abcdef12 b " + "0af3" * 8], 90).withColumns({c: F.lit(1) for c in odd(spark).columns[5:]}))
    got = secret_scan.redact(df)
    assert got.columns == df.columns and got.count() == 10
    row = got.where("doc_id = 90").first()
    assert row["text"] == "a [SECRET] b [SECRET]" and row["n_chars"] == len(row["text"]) and row["_spans"] == 1
    assert got.where("doc_id = 0").first()["text"] is None


# --- pipeline and registry ----------------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts, rows = labelled(spark, lambda r, t: "you idiot " + t + " you moron")
    texts.unionByName(docs(spark, [rows[1][2]], 900)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(b)) for i, b, _ in rows], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secret_scan", "mixing", "bpe"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {i for i, b, _ in rows if not b}


def test_registry():
    from logweave.llm import queries

    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
