"""Lexical retrieval packing: windows filled with BM25 neighbours of their first document.

Documents are tokenised once, into a written table. With it go the statistics of BM25, over all documents: how many
there are, their mean length, and how many hold each token of the vocabulary, whose size bounds what is kept of them.

Shards are made of alike documents: each one's signature names three of its tokens, those that come first in an order
drawn for each token with weights by its inverse document frequency, so that documents agree on them the likelier the
more rare tokens they share (weighted minwise hashing, over a sketch of the SKETCH tokens with the least hashes). Tokens
are named by an order that puts those of one topic together, which is fitted on SAMPLE sketches. All documents are sorted by signature over range partitions, where rows with equal signatures, copies too, are cut by their
number, and each partition's stream is cut into shards of SHARD_TOKENS, one of which is in memory at a time.

Each shard holds an inverted index of its documents with BM25 weights. A window starts with a seed: what was cut off the
window before, or the next unused document. The index ranks all unused documents of the shard against the seed, and they
follow in that order until the window is full; the last is cut, and its rest seeds the next window. So a shard is one
gapless stream of windows and no document is used twice. What is left at the end of a shard is cut into lengths that are
powers of two, which need no padding.

Defined results: a null or empty text is its end mark alone; a text longer than a window fills as many as it needs;
repeated rows are packed each; equal scores go by signature and number; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import materialize, remember, ship, table

WINDOW = 4096
END = 2
SHARD_TOKENS = 1 << 20
#: Shards that a task packs, about.
TASK_SHARDS = 8
K1, B = 1.2, 0.75
SKETCH = 64
#: Sketches of documents that tokens are put in order by, and the directions in which these are told apart.
SAMPLE, DIRECTIONS = 4096, 16
#: Words and other stretches of text that a worker remembers, and bytes that are cut into words at a time.
WORDS, OTHERS, PIECE = 1_000_000, 100_000, 1 << 20
_LETTERS = bytes(c for c in range(256) if chr(c).isalpha())
_LOWER = bytes(ord(low) if len(low := chr(c).lower()) == 1 and ord(low) < 256 else c for c in range(256))
_SPACE = b" \t\n\x0b\x0c\r"
#: An apostrophe may begin a contraction, so texts with one aren't cut here.
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_DIGITS = b"0123456789"
#: Kinds of bytes: none (white space), letters, digits, signs.
_KINDS = np.array([1 if c in _LETTERS else 2 if c in _DIGITS else 3 if c in _SIGNS else 0 for c in range(256)], np.uint8)
_U = np.uint64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MULTIPLY = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def plain(text: str) -> bytes | None:
    """A text of Latin-1 letters, digits, ASCII signs and white space in lower case; None for others.

    In these, runs of letters, single digits and runs of signs are the tokenizer's own pre-tokens."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if raw.translate(None, _LETTERS + _SPACE + _DIGITS + _SIGNS) or b"<|" in raw:
        return None
    return raw.translate(_LOWER)


def pieces(raw: bytes) -> Iterator[bytes]:
    """A long text cut between words into PIECE bytes at most, but for a run of letters or signs that is longer."""
    at = 0
    while len(raw) - at > PIECE:
        cut = max(raw.rfind(c, at, at + PIECE) for c in (b" ", b"\n"))
        if cut <= at:
            kind = _KINDS[np.frombuffer(raw, np.uint8, PIECE + 1, at)]
            between = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2))
            if not len(between):  # one run, which goes with what follows it
                break
            cut = at + int(between[-1]) + 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


class Words:
    """A hash table of words of 16 bytes at most, as two numbers each, and of their ids; lookups are by the array."""

    BITS = 22

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        self.keys = np.empty((2, 0), np.uint64)
        self.flat = np.empty(0, self.kind)
        self.at, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.used = np.empty(0, bool)
        self.longer: dict[bytes, int] = {}

    def keep_used(self) -> None:
        """Forget words that were never met again since they came or since the last time; of too many, all."""
        kept = np.flatnonzero(self.used)
        if len(kept) > len(self) // 2:
            return self.clear()
        longer = {n: w for n, w in self.longer.items() if self.used[w]}
        short = np.setdiff1d(kept, list(longer.values()))
        keys, order = self.keys[:, short], np.r_[short, np.array(list(longer.values()), np.int64)].astype(np.int64)
        count, flat = self.count[order], self.flat[self._places(order)]
        self.clear()
        self.add(keys[0], keys[1], flat, count, list(longer))

    def _places(self, word: np.ndarray) -> np.ndarray:
        count = self.count[word]
        done = np.cumsum(count)
        return np.repeat(self.at[word] - (done - count), count) + np.arange(int(done[-1]) if len(done) else 0)

    def ids(self, word: np.ndarray) -> np.ndarray:
        return self.flat[self._places(word)]

    def __len__(self) -> int:
        return len(self.at)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a * _MULTIPLY[0] ^ (b + (a >> _U(32))) * _MULTIPLY[1]
        return ((h ^ (h >> _U(29))) * _MULTIPLY[0] >> _U(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 of unknown ones."""
        slot = self._slot(a, b)
        out = self.slots[slot].astype(np.int64)
        if not len(self):
            return out
        off = np.flatnonzero((out >= 0) & ((self.keys[0][out] != a) | (self.keys[1][out] != b)))
        while len(off):
            slot[off] = (slot[off] + 1) & ((1 << self.BITS) - 1)
            out[off] = got = self.slots[slot[off]]
            off = off[(got >= 0) & ((self.keys[0][got] != a[off]) | (self.keys[1][got] != b[off]))]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, count: np.ndarray, longer: list[bytes]) -> None:
        """New words by their numbers, then longer ones by their bytes; ``ids`` and how many are each's, in this order."""
        first = len(self)
        self.at = np.r_[self.at, len(self.flat) + np.cumsum(count) - count]
        self.count = np.r_[self.count, count]
        self.flat = np.r_[self.flat, ids]
        self.used = np.r_[self.used, np.zeros(len(count), bool)]
        none = np.zeros(len(longer), np.uint64)
        self.keys = np.concatenate([self.keys, [np.r_[a, none], np.r_[b, none]]], axis=1)
        own, slot = np.arange(first, first + len(a), dtype=np.int32), self._slot(a, b)
        while len(own):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = own[free]
            left = self.slots[slot] != own
            own, slot = own[left], (slot[left] + 1) & ((1 << self.BITS) - 1)
        self.longer.update(zip(longer, range(first + len(a), len(self)), strict=True))


class Tokens:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and marks the ends of words.

    Words are remembered. New ones are encoded many at a time, with spaces between, and told apart by the marks.
    Texts with anything else are cut at spaces, and what stands between goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = Words(self.kind)
        self.others: dict[str, bytes] = {}

    def forget(self) -> None:
        self.words.clear()
        self.others.clear()

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in encoded]

    def _learned(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, one after another, and how many each has."""
        ids, count = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            (data,) = self._ids([b" ".join(part).decode("latin-1")])
            own = np.frombuffer(data, self.kind)
            last = np.flatnonzero(self.ends[own]) + 1
            if len(last) != len(part):  # a tokenizer without such marks
                each = [np.frombuffer(x, self.kind) for x in self._ids([w.decode("latin-1") for w in part])]
                own, last = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(own)
            count.append(np.diff(np.r_[0, last]))
        return np.concatenate(ids), np.concatenate(count)

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts, which are cut and looked up together."""
        data = b"\n".join(texts) + bytes(16)
        raw = np.frombuffer(data, np.uint8)
        kind = _KINDS[raw]
        alone, before = kind == 2, np.r_[np.uint8(0), kind[:-1]]
        start = np.flatnonzero((kind != 0) & ((kind != before) | alone))
        end = np.flatnonzero((kind != 0) & ((np.r_[kind[1:], np.uint8(0)] != kind) | alone)) + 1
        size = end - start
        eight = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (len(raw) - 7,), (1,))
        a = eight[start] & _FIRST[np.minimum(size, 8)]
        b = np.zeros(len(start), np.uint64)
        two = np.flatnonzero(size > 8)
        b[two] = eight[start[two] + 8] & _FIRST[np.minimum(size[two] - 8, 8)]
        long = np.flatnonzero(size > 16)
        names = [data[s:e] for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        word = self.words.find(a, b)
        word[long] = [self.words.longer.get(n, -1) for n in names]
        new = word < 0
        if len(self.words):
            self.words.used[word[~new]] = True
        lost = np.flatnonzero(new)
        if len(lost):
            unknown = sorted({n for n, w in zip(names, word[long].tolist(), strict=True) if w < 0})
            short = lost[size[lost] <= 16]
            one = short[np.lexsort((b[short], a[short]))]
            one = one[np.r_[True, (a[one][1:] != a[one][:-1]) | (b[one][1:] != b[one][:-1])]] if len(one) else one
            if len(self.words) and len(self.words) + len(one) + len(unknown) > WORDS:
                self.words.keep_used()
                return self._plain(texts)
            learned = self._learned([data[s:e] for s, e in zip(start[one].tolist(), end[one].tolist(), strict=True)] + unknown)
            self.words.add(a[one], b[one], *learned, unknown)
            word[short] = self.words.find(a[short], b[short])
            word[long] = [self.words.longer[n] for n in names]
        ids, done = self.words.ids(word), np.cumsum(self.words.count[word])
        last = np.cumsum([len(t) + 1 for t in texts])
        cut = np.r_[0, done][np.searchsorted(start, last)].tolist()
        return [ids[x:y].tobytes() for x, y in zip([0, *cut], cut, strict=False)]

    def _other(self, texts: list[str]) -> list[bytes]:
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        wanted = set().union(*chunks)
        new = list(wanted.difference(self.others))
        if len(self.others) + len(new) > OTHERS:
            self.others.clear()
            new = list(wanted)
        self.others.update(zip(new, self._ids(new), strict=True))
        return [b"".join(map(self.others.__getitem__, c)) for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            nonlocal size
            for (k, _), ids in zip(held, self._plain([p for _, p in held]), strict=True):
                out[k].append(ids)
            held.clear()
            size = 0

        others = []
        for k, text in enumerate(texts):
            raw = plain(text)
            if raw is None:
                others.append(k)
                continue
            for p in pieces(raw):
                if held and size + len(p) > PIECE:
                    flush()
                held.append((k, p))
                size += len(p)
        if held:
            flush()
        for k, ids in zip(others, self._other([texts[k] for k in others]), strict=True):
            out[k].append(ids)
        return [b"".join(parts) for parts in out]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


@dataclass
class Statistics:
    """Of all documents: how many hold each token, how many there are, and their mean length."""

    held: np.ndarray
    docs: int
    mean: float

    def idf(self) -> np.ndarray:
        return np.log1p((self.docs - self.held + 0.5) / (self.held + 0.5))


def hashed(tokens: np.ndarray, seed: int = 0) -> np.ndarray:
    x = tokens.astype(np.uint64) * _MULTIPLY[0] + _U(seed)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def sketch(distinct: np.ndarray) -> np.ndarray:
    """The SKETCH tokens of a set with the least hashes."""
    return distinct if len(distinct) <= SKETCH else distinct[np.argpartition(hashed(distinct), SKETCH)[:SKETCH]]


def _along(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, whose cells lie together."""
    return np.add.reduceat(values, np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]), axis=0)


def token_order(sketches: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Places of tokens in an order where those that occur in the same documents are neighbours; unseen ones come last.

    Tokens are vectors of the leading singular space of the sample's weighted incidence, and are halved along the direction
    in which they differ most, again and again."""
    out = np.full(len(idf), len(idf), np.int64)
    sketches = [s for s in sketches if len(s)]
    if not sketches:
        return out
    row = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    seen, column = np.unique(np.concatenate(sketches).astype(np.int64), return_inverse=True)
    weight = np.maximum(idf[seen[column]], 1e-9).astype(np.float32)
    weight /= np.sqrt(_along(row, weight * weight))[row]
    by = np.argsort(column, kind="stable")

    def tokens_of(space: np.ndarray) -> np.ndarray:
        return _along(column[by], (weight[:, None] * space[row])[by])

    space = np.random.default_rng(0).standard_normal((len(sketches), DIRECTIONS)).astype(np.float32)
    for _ in range(4):
        space, _ = np.linalg.qr(_along(row, weight[:, None] * tokens_of(space)[column]))
    at = tokens_of(space)
    at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)
    left, order = [np.arange(len(seen))], []
    while left:
        own = left.pop()
        if len(own) <= 8:
            order.append(own)
            continue
        x = at[own] - at[own].mean(0)
        _, directions = np.linalg.eigh(x.T @ x)
        own = own[np.argsort(x @ directions[:, -1], kind="stable")]
        left += [own[len(own) // 2 :], own[: len(own) // 2]]
    out[seen[np.concatenate(order)]] = np.arange(len(seen))
    return out


class Signatures:
    """Signatures of sketches under one weight for each token: an exponential variable drawn from the token, by its weight.

    The token with the least of these is drawn from a set in proportion to the weights, and alike sets agree on it. Tokens
    are named by their place in ``token_order``, so that signatures of one topic are neighbours too."""

    def __init__(self, statistics: Statistics, sample: list[np.ndarray]):
        tokens, idf = np.arange(len(statistics.held)), statistics.idf()
        drawn = -np.log((hashed(tokens, 7) >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
        # A token of one document brings it together with no other.
        self.rank = drawn / np.where(statistics.held > 1, np.maximum(idf, 1e-9) ** 2, 1e-9)
        self.name = np.minimum(token_order(sample, idf), (1 << 21) - 1)

    def of(self, sketch: np.ndarray) -> int:
        first = sketch[np.argsort(self.rank[sketch], kind="stable")[:3]]
        names = [*self.name[first].tolist(), 0, 0, 0]
        return names[0] << 42 | names[1] << 21 | names[2]


class Index:
    """An inverted index of one shard with BM25 weights; used documents leave its postings now and then."""

    def __init__(self, docs: list[np.ndarray], statistics: Statistics | None = None):
        bags = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t.astype(np.int64) for t, _ in bags]
        n = len(docs)
        term = np.concatenate(self.terms)
        doc = np.repeat(np.arange(n), [len(t) for t in self.terms])
        tf = np.concatenate([c for _, c in bags]).astype(np.float64)
        length = np.array([len(d) for d in docs], np.float64)
        held = np.bincount(term)
        statistics = statistics or Statistics(held, n, length.mean())
        weight = statistics.idf()[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / statistics.mean))
        order = np.argsort(term, kind="stable")
        self.width = len(held)
        self.term, self.doc, self.weight = term[order], doc[order], weight[order]
        self.live = np.ones(n, bool)
        self.left = self.indexed = n
        self._point()

    def _point(self) -> None:
        self.at = np.searchsorted(self.term, np.arange(self.width + 1))

    def use(self, doc: int) -> None:
        self.live[doc] = False
        self.left -= 1
        if self.left * 2 < self.indexed:
            keep = self.live[self.doc]
            self.term, self.doc, self.weight = self.term[keep], self.doc[keep], self.weight[keep]
            self.indexed = self.left
            self._point()

    def ranked(self, seed: int) -> np.ndarray:
        """All unused documents, best first; equal scores by number."""
        q = self.terms[seed]
        start, count = self.at[q], self.at[q + 1] - self.at[q]
        at = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        score = np.bincount(self.doc[at], self.weight[at], len(self.live))
        left = np.flatnonzero(self.live)
        return left[np.argsort(-score[left], kind="stable")]


def chain(docs: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> list[int]:
    """The order of a shard's documents: each window's seed, then its neighbours as they fit."""
    index = Index(docs, statistics)
    order: list[int] = []
    filled, upcoming = 0, 0
    while index.left:
        if filled % window == 0 or not order:
            while not index.live[upcoming]:
                upcoming += 1
            seed = upcoming
            order.append(seed)
            index.use(seed)
            filled += len(docs[seed])
        else:
            seed = order[-1]  # its rest opened this window
        room = -filled % window
        if not room:
            continue
        for d in index.ranked(seed).tolist():
            order.append(d)
            index.use(d)
            filled += len(docs[d])
            room -= len(docs[d])
            if room <= 0:
                break
    return order


def windows(total: int, window: int = WINDOW) -> list[int]:
    """Lengths of the sequences of a stream: full windows, then powers of two."""
    full, rest = divmod(total, window)
    return [window] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_shard(first: int, ids: list, docs: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> dict[str, list]:
    """The pieces of a shard's documents; its sequences are numbered from ``first`` on."""
    out: dict[str, list] = {k: [] for k in ("doc_id", *_PIECE)}
    lengths = windows(sum(map(len, docs)), window)
    number, offset = 0, 0
    for d in chain(docs, window, statistics):
        raw = docs[d].astype("<u4")
        start = 0
        while start < len(raw):
            n = min(len(raw) - start, lengths[number] - offset)
            for name, v in zip(out, (ids[d], start, n, zlib.crc32(raw[start : start + n]), len(raw), first + number, offset), strict=True):
                out[name].append(v)
            start, offset = start + n, offset + n
            if offset == lengths[number]:
                number, offset = number + 1, 0
    return out


def tokenised(spark: SparkSession, docs: DataFrame, path: str | None) -> DataFrame:
    """A written table: doc_id, number, ids and sketch of each document, and rows of counts, by task, for the statistics."""
    ship(spark)
    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", to_arrow_type(kind)), ("number", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("sketch", pa.binary()), ("held", pa.binary()), ("docs", pa.int64()), ("tokens", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        import public_tokenizers

        own = tokens(path or public_tokenizers.path("word_bpe_49k.json"))
        remember("packing", own.forget)
        end = np.array([END], own.kind).tobytes()
        held, n, total = np.zeros(own.size, np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [b + end for b in own.encode([t or "" for t in part.column(1).to_pylist()])]
                distinct = [np.unique(np.frombuffer(b, own.kind)) for b in ids]
                held += np.bincount(np.concatenate(distinct), minlength=own.size)
                n, total = n + len(ids), total + sum(map(len, ids)) // own.kind.itemsize
                none = [None] * len(ids)
                sketches = [sketch(d).astype("<u4").tobytes() for d in distinct]
                cols = (part.column(0), part.column(2), [own.kind.itemsize] * len(ids), ids, sketches, none, none, none)
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, cols, strict=True)), schema=schema)
        if n:
            last = {c: [None] for c in schema.names} | {"held": [held.tobytes()], "docs": [n], "tokens": [total]}
            yield pa.RecordBatch.from_pydict(last, schema=schema)

    # The number tells rows apart that are equal in all else; it is drawn once, as the table is written.
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("number"))
    names = ", ".join(("number long", "width int", "ids binary", "sketch binary", "held binary", "docs long", "tokens long"))
    return materialize(spark, rows.mapInArrow(run, f"doc_id {kind.simpleString()}, {names}"), "tokens")


def statistics_of(rows: DataFrame) -> tuple[Statistics, int]:
    """Sums over all tasks' counts, and the number of all tokens. What reaches the driver is the vocabulary's size."""

    def spread(batches):
        for batch in batches:
            for data, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = np.frombuffer(data, np.int64)
                at = np.flatnonzero(held)
                # Below zero: documents, tokens, and the vocabulary's size, counted once a task.
                yield pa.RecordBatch.from_pydict({"token": np.r_[at, -1, -2, -3], "n": np.r_[held[at], n, total, len(held)], "most": np.r_[held[at], n, total, len(held)]})

    counts = rows.where("held is not null").select("held", "docs", "tokens").mapInArrow(spread, "token long, n long, most long")
    got = {r["token"]: (r["n"], r["most"]) for r in counts.groupBy("token").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect()}
    if not got:
        return Statistics(np.zeros(1, np.int64), 0, 1.0), 0
    held = np.zeros(got[-3][1], np.int64)
    for token, (n, _) in got.items():
        if token >= 0:
            held[token] = n
    docs, total = got[-1][0], got[-2][0]
    return Statistics(held, docs, total / docs), total


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document: where its ids lie in the sequences."""
    rows = tokenised(spark, docs, path)
    statistics, total = statistics_of(rows)
    documents = rows.where("held is null")
    # About SAMPLE sketches of SKETCH tokens at most, whatever the number of documents.
    drawn = F.pmod(F.xxhash64("number"), F.lit(max(1, statistics.docs))) < SAMPLE
    sample = sorted((r["number"], r["sketch"]) for r in documents.where(drawn).select("number", "sketch").collect())
    signatures = Signatures(statistics, [np.frombuffer(x, "<u4") for _, x in sample])
    held, signs = spark.sparkContext.broadcast(statistics), spark.sparkContext.broadcast(signatures)
    limit = SHARD_TOKENS
    shards = max(1, -(-total // limit))
    tasks = max(-(-shards // TASK_SHARDS), min(spark.sparkContext.defaultParallelism, shards))

    @F.pandas_udf("long")
    def signature(sketches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in sketches:
            yield pd.Series([signs.value.of(np.frombuffer(x, "<u4")) for x in s], dtype="int64")

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *((c, pa.int64()) for c in _PIECE)])

    def fill(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        ids, own, size = [], [], 0

        def shard():
            nonlocal first
            out = pack_shard(first, ids, own, window, held.value)
            first = max(out["sequence_id"]) + 1
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in batches:
            for doc_id, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                own.append(np.frombuffer(data, f"<u{width}"))
                size += len(own[-1])
                if size >= limit:
                    yield shard()
                    ids, own, size = [], [], 0
        if own:
            yield shard()

    signed = documents.select("doc_id", "width", "ids", "number", signature("sketch").alias("signature"))
    order = signed.repartitionByRange(tasks, "signature", "number").sortWithinPartitions("signature", "number")
    return order.select("doc_id", "width", "ids").mapInArrow(fill, f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _PIECE))


def op1_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
