"""Byte-level BPE encoding and decoding by ranks, with a hierarchical-bitmap queue of merges.

A pre-token is a linked list of byte runs. Each pair of neighbours that the vocabulary knows lies in the bucket of
its rank, by the position of its left run. A two-level bitmap of the buckets in use gives the lowest rank by
find-first-set; of its entries the leftmost valid one is merged, and entries whose pair has changed since are
skipped when met. A merge touches two neighbours, so long pre-tokens cost n log n at worst, not n squared.

Texts repeat words, so a worker remembers, up to a bound, the ids of what lies between two spaces. That is exact
where the space belongs to the following run of letters, digits or signs; texts with longer runs of white space
are split by the pattern as a whole.

Defined results: a null or empty text has no ids and the digests of empty input; strings that look like special
tokens are ordinary text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from heapq import heappop, heappush

import regex
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import map_batches, table

WORD = 256
SHIFT, MASK = 8, 255
BIT = [1 << k for k in range(WORD)]
#: Stretches after a space, and others, that a worker remembers: about 300 and 40 MB.
AFTER_SPACE, REMEMBERED = 1_400_000, 200_000


class RankQueue:
    """Buckets of positions by rank, under bitmaps of 256 ranks each and a bitmap of those that aren't empty.

    ``Codec.merge`` works on its parts directly, since calls would cost more than what they do."""

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // WORD + 1)
        self.buckets: dict[int, list[int]] = {}


class Remembered(dict):
    """A bounded memory of a function; it starts anew when full."""

    def __init__(self, make, bound: int = REMEMBERED):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.find = regex.compile(pattern).findall
        self.pretoken = Remembered(self._ids)
        self.first, self.after_space = Remembered(self._first), Remembered(lambda chunk: self._first(" " + chunk, 1), AFTER_SPACE)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # of the run that starts at a position
        back = list(range(-1, n))  # start of the run before
        due = [-1] * n  # rank under which the pair at a position waits now
        words, buckets, top = self.queue.words, self.queue.buckets, 0
        new = [(r, i) for i in range(n - 1) if (r := rank_of(piece[i : i + 2], -1)) >= 0]
        while new or top:
            for r, i in new:
                due[i] = r
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = [i]
                    word = r >> SHIFT
                    words[word] |= BIT[r & MASK]
                    top |= BIT[word]
                else:
                    heappush(bucket, i)
            new = []
            # The lowest rank in use, by its word and its bit there; of its positions the leftmost.
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            r = (word << SHIFT) + low.bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                words[word] = bits ^ low
                if bits == low:
                    top ^= BIT[word]
            if due[i] != r:
                continue  # the pair has changed since
            right = end[i]
            e = end[i] = end[right]
            due[right] = due[i] = -1
            if e < n:
                back[e] = i
                if (r := rank_of(piece[i : end[e]], -1)) >= 0:
                    new.append((r, i))
            b = back[i]
            if b >= 0:
                r = rank_of(piece[b:e], -1)
                if r < 0:
                    due[b] = -1
                elif due[b] != r:
                    new.append((r, b))
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i : end[i]]))
            i = end[i]
        return out

    def _first(self, text: str, space: int = 0) -> bytes | None:
        """Encoded ids of what stands between two spaces, or None if more than one white space meets there."""
        if len(text) == space or text[space].isspace() or text[-1].isspace():
            return None
        pieces = self.find(text)
        if len(pieces) == 1:
            return self._ids(text)
        # The first piece alone would be what stands between two spaces too, and is remembered as such.
        held = self.after_space[pieces[0][1:]] if space and len(pieces[0]) > 1 else self.pretoken[pieces[0]]
        return held + b"".join(map(self.pretoken.__getitem__, pieces[1:]))

    def _ids(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pretoken.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return self.first[first] + b"".join(map(self.after_space.__getitem__, rest))
        except TypeError:  # a None: white space meets
            return self._pieces(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (bytes) of each text."""
    return _run(docs, ranks, pattern, False)


def _run(docs: DataFrame, ranks: str | None, pattern: str | None, digests: bool) -> DataFrame:
    def encode(batch):
        import public_tokenizers

        own = codec(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
        decoded = map(own.decode, ids)
        if digests:
            decoded = [hashlib.sha256(b).hexdigest() for b in decoded]
            yield {
                "doc_id": batch.column(0),
                "n_tokens": [len(b) // 4 for b in ids],
                "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
                "decoded_sha256": decoded,
            }
        else:
            yield {"doc_id": batch.column(0), "n_tokens": [len(b) // 4 for b in ids], "ids": ids, "decoded": list(decoded)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    values = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    return map_batches(docs.select("doc_id", "text"), encode, f"doc_id {kind}, n_tokens long, {values}")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(table(spark, sf_dir, "documents"), None, None, True)
