"""BPE encoding and decoding (operator 4): a bounded-lookahead streaming transducer.

Pre-tokens (words) go through `Transducer`, many at once: it reads a window and the lookahead of each word, merges them
over numpy arrays (in each round every word merges all places of its lowest-ranked pair), emits the tokens that no later
symbol can change, and goes on behind them. A word that ends inside its window is done in one step, by the same code. A
bounded memory of words saves repeated ones.

How far a later symbol reaches back (the sufficient lookahead) is computed from the merge list. Take two inputs that
agree up to a place and apply the merges in rank order. The place where their token rows first differ moves left only
when a merge (u, v) finds u just left of it and v just right of it in one of the two, and then by the length of u. The
next merge that moves it needs a right part which begins, in the derivation, with that u. So the longest chain of merges
of rising rank, each with the former's u on the left spine of its v, bounds the sum of the lengths.

Ids are decoded by `TextDecoder`, an incremental machine from bytes to text whose state is what a character still lacks.

Null texts count as empty (no tokens). Texts of any length are read in pieces cut at blanks. Rows that repeat are rows
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import table, tidy

_NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if visible, else 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """A word-level BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max(max(vocab.values()), *self.specials.values()) + 1)
        for token, i in (vocab | self.specials).items():
            self.tokens[i] = token
        self.id_text = [str(i) for i in range(len(self.tokens))]
        letters = byte_letters()
        self.plain = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + self.end] for x in letters], np.int64)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._hash_pairs()
        self.lookahead = self._sufficient_lookahead()
        byte = {x: b for b, x in enumerate(letters)}
        #: The bytes that a token shows, and those that it stands for.
        self.shown_bytes = [t.encode() for t in self.tokens]
        self.raw_bytes = [t.encode() if t in self.specials else bytes(byte[x] for x in t.removesuffix(self.end)) + b" " * (bool(self.end) and t.endswith(self.end)) for t in self.tokens]

    def _hash_pairs(self) -> None:
        bits = max(4, int(np.ceil(np.log2(len(self.left) * 3))))
        self.shift, size = np.uint64(64 - bits), 1 << bits
        keys = self.left * np.int64(1 << 20) + self.right
        self.slot_key, self.slot_rank = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.slot_key[slot] >= 0 and self.slot_key[slot] != key:
                slot = (slot + 1) & (size - 1)
            if self.slot_key[slot] < 0:
                self.slot_key[slot], self.slot_rank[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair in the merge list, or _NONE."""
        keys = left * np.int64(1 << 20) + right
        slot = self._slots(keys)
        held = self.slot_key[slot]
        out = np.where(held == keys, self.slot_rank[slot], _NONE)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slot_key) - 1)
            held = self.slot_key[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.slot_rank[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out

    def _sufficient_lookahead(self) -> int:
        length: dict[int, int] = dict.fromkeys([*self.plain.tolist(), *self.final.tolist()], 1)
        spine: dict[int, int] = {}
        best: dict[int, int] = {}
        most = 1
        for u, v, w in zip(self.left.tolist(), self.right.tolist(), self.made.tolist(), strict=True):
            length.setdefault(w, length[u] + length[v])
            spine.setdefault(w, u)
            reach, at = 0, v
            while at is not None:
                reach, at = max(reach, best.get(at, 0)), spine.get(at)
            best[u] = max(best.get(u, 0), length[u] + reach)
            most = max(most, best[u])
        return most

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words given as rows of symbols, one after the other; and the number of tokens of each word."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names = np.arange(len(sizes))
        while len(names):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.full(len(symbols), _NONE, np.int64)
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
            rank[ends - 1] = _NONE
            least = np.minimum.reduceat(rank, starts)
            live = least < _NONE
            if not live.all():
                rest = ~live[row]
                done.append((names[~live], sizes[~live], symbols[rest]))
                keep = live[row]
                symbols, rank, row = symbols[keep], rank[keep], row[keep]
                names, sizes = names[live], sizes[live]
                if not len(names):
                    break
                row = np.repeat(np.arange(len(sizes)), sizes)
                least = least[live]
            hit = rank == least[row]
            # of places that overlap (a pair of equal symbols in a run) every second is taken, from the left
            again = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(again):
                places = np.flatnonzero(hit)
                new = np.ones(len(places), bool)
                new[1:] = np.diff(places) > 1
                first = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
                hit[places[(places - first) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            sizes = sizes - np.bincount(row[at], minlength=len(sizes))
            symbols = symbols[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who = np.concatenate([d[0] for d in done])
        many = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[2] for d in done])
        order = np.argsort(who)
        begin = (np.cumsum(many) - many)[order]
        many = many[order]
        at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return flat[at], many


class Transducer:
    """Encodes words whose bytes arrive in pieces; looks at a window and the lookahead of each word at most."""

    def __init__(self, merges: Merges, window: int = 1024):
        self.merges, self.window, self.reach = merges, window, window + merges.lookahead
        self.held = np.zeros(0, np.int64)
        #: Symbols that each token covers.
        self.covers = np.array([len(t.removesuffix(merges.end)) if merges.end else len(t) for t in merges.tokens], np.int64)

    def step(self, symbols: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words given as rows of symbols, one after the other: the tokens now stable, how many of each word, and how many
        symbols they cover. All tokens of words that are whole are stable, else those that end in the window."""
        tokens, many = self.merges.merge(symbols, sizes)
        covers = np.concatenate([[0], np.cumsum(self.covers[tokens])])
        first = np.cumsum(many) - many
        stable = np.repeat(whole, many) | (covers[1:] - np.repeat(covers[first], many) <= self.window)
        kept = np.concatenate([[0], np.cumsum(stable)])
        many = kept[first + many] - kept[first]
        return tokens[stable], many, covers[first + many] - covers[first]

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """The tokens of words given as rows of bytes, each with a last byte of its own."""
        out: list[list[int]] = [[] for _ in sizes]
        ends = np.cumsum(sizes)
        at, open_ = ends - sizes, np.arange(len(sizes))
        while len(open_):
            # as many words as make a quarter of a million symbols
            size = np.minimum(ends[open_] - at[open_], self.reach)
            now = open_[: max(1, int(np.searchsorted(np.cumsum(size), 1 << 18, side="right")))]
            size = size[: len(now)]
            stops = np.cumsum(size)
            place = np.repeat(at[now] - (stops - size), size) + np.arange(stops[-1])
            symbols = self.merges.plain[data[place]]
            whole = at[now] + size == ends[now]
            last = stops[whole] - 1
            symbols[last] = self.merges.final[data[place[last]]]
            tokens, many, taken = self.step(symbols, size, whole)
            begin, flat = 0, tokens.tolist()
            for k, to in zip(now.tolist(), np.cumsum(many).tolist(), strict=True):
                out[k] += flat[begin:to]
                begin = to
            at[now] += taken
            open_ = np.concatenate([now[~whole], open_[len(now) :]])
        return out

    def feed(self, data: bytes) -> list[int]:
        """Of one word: take bytes that are not its last and return the tokens now stable."""
        self.held = np.concatenate([self.held, self.merges.plain[np.frombuffer(data, np.uint8)]])
        out: list[int] = []
        while len(self.held) >= self.reach:
            tokens, _, taken = self.step(self.held[: self.reach], np.array([self.reach]), np.zeros(1, bool))
            out += tokens.tolist()
            self.held = self.held[taken[0] :]
        return out

    def finish(self, data: bytes) -> list[int]:
        """The rest of the word, with its end, and all tokens not yet given."""
        out = self.feed(data[:-1])
        last = self.merges.final[np.frombuffer(data[-1:], np.uint8)]
        tokens, _, _ = self.step(np.concatenate([self.held, last]), np.array([len(self.held) + 1]), np.ones(1, bool))
        self.held = self.held[:0]
        return out + tokens.tolist()


class TextDecoder:
    """Byte-to-text state machine: ids come in pieces; bytes wait until they form a character.

    A vocabulary without a decoder shows its strings as they are, with blanks between them; with raw=True the letters
    stand for bytes and a word's end for a blank."""

    def __init__(self, merges: Merges, raw: bool = False):
        self.table, self.between = (merges.raw_bytes, b"") if raw else (merges.shown_bytes, b" ")
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: Sequence[int], last: bool = False) -> str:
        data = self.between.join(map(self.table.__getitem__, ids))
        if ids:
            data, self.begun = (self.between + data if self.begun else data), True
        return self.state.decode(data, last)


_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+")


#: Letters that only the newest character table has may split otherwise than in the library.
_ANY = regex.compile(r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Control characters that Python takes for white space and the tokenizer does not.
_CONTROL = re.compile("[\x1c-\x1f]")
#: Lower case is taken letter by letter: a sigma at a word's end gets no form of its own.
_SIGMA = "Σ"


class Encoder:
    """Texts to token ids with a bounded memory of words; `piece` is the most characters read at once."""

    def __init__(self, path: str, most_words: int = 100_000, piece: int = 1 << 20, window: int = 1024):
        self.merges = Merges(path)
        self.transducer = Transducer(self.merges, window)
        self.most, self.piece = most_words, piece
        #: The ids of a word; a word of one token shares its tuple with others.
        self.known: dict[str, tuple[int, ...]] = {}
        self.single = [(i,) for i in range(len(self.merges.tokens))]
        marks = "|".join(re.escape(x) for x in sorted(self.merges.specials, key=len, reverse=True))
        self.marks = re.compile(f"({marks})") if marks else None

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token is a list item of its own, led by NUL."""
        if self.marks and "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.marks.split(text)):
                if k % 2:
                    out.append("\0" + part)
                elif part:
                    out += self._plain_words(part)
            return out
        return self._plain_words(text)

    @staticmethod
    def _plain_words(text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
            return (_ANY if _CONTROL.search(text) else _ASCII).findall(text)
        text = unicodedata.normalize("NFC", text)
        if _SIGMA in text:
            text = text.replace(_SIGMA, "σ")
        return _ANY.findall(text.lower())

    def learn(self, words: set[str]) -> None:
        """Encode words not yet known, all at once."""
        new = list(words.difference(self.known))
        for w in new:
            if w[0] == "\0" and w[1:] in self.merges.specials:
                self.known[w] = self.single[self.merges.specials[w[1:]]]
        new = [w for w in new if w not in self.known]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            raw = [w.encode("utf-8", "surrogatepass") for w in some]
            found = self.transducer.encode(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))
            for w, ids in zip(some, found, strict=True):
                self.known[w] = self.single[ids[0]] if len(ids) == 1 else tuple(ids)

    def pieces(self, text: str) -> Iterator[str]:
        """The text in parts of about `piece` characters, cut after blanks."""
        at = 0
        while len(text) - at > self.piece:
            to = text.rfind(" ", at, at + self.piece) + 1
            if to <= at:
                to = text.find(" ", at + self.piece) + 1 or len(text)
            yield text[at:to]
            at = to
        yield text[at:] if at else text

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; the texts should hold a few million characters at most."""
        if len(self.known) > self.most:
            self.known.clear()
        split = [self.words(x) for x in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [list(itertools.chain.from_iterable(map(get, words))) for words in split]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.pieces(text) for i in self.encode_batch([part])[0]]

    def decode(self, ids: Sequence[int]) -> str:
        """As the library: skip_special_tokens=False."""
        return TextDecoder(self.merges).feed(ids, last=True)


class _Digest:
    """Digests of a text's ids and of its decoded text, fed by pieces."""

    def __init__(self, encoder: Encoder):
        self.decoder, self.count, self.ids, self.text = TextDecoder(encoder.merges), 0, hashlib.sha256(), hashlib.sha256()
        self.shown = encoder.merges.id_text.__getitem__

    def feed(self, ids: list[int]) -> None:
        if ids:
            self.ids.update((" " * bool(self.count) + " ".join(map(self.shown, ids))).encode())
            self.text.update(self.decoder.feed(ids).encode())
            self.count += len(ids)

    def row(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.feed([], last=True).encode())
        return self.count, self.ids.hexdigest(), self.text.hexdigest()


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", together: int = 1 << 20) -> DataFrame:
    """Per row: the key, the number of tokens and digests of the ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[tuple[int, str, str]] = []
            waiting: list[str] = []
            size = 0

            def flush() -> None:
                nonlocal size
                for ids in enc.encode_batch(waiting) if waiting else ():
                    digest = _Digest(enc)
                    digest.feed(ids)
                    rows.append(digest.row())
                waiting.clear()
                size = 0

            for value in texts:
                one = value.as_py() or ""
                if len(one) > enc.piece:
                    flush()
                    digest = _Digest(enc)
                    for part in enc.pieces(one):
                        digest.feed(enc.encode_batch([part])[0])
                    rows.append(digest.row())
                    continue
                waiting.append(one)
                size += len(one)
                if size > together:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([keys, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        # a worker may live on for other queries
        enc.known.clear()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(run), f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and the token ids as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [enc.encode(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(run), f"{key} {kind}, ids array<int>")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary())
