"""Vectors of texts through a pluggable embedder.

An embedder turns a list of texts into rows of unit length. The default one counts words in hashed buckets and
needs no model; a sentence model can be plugged in, loaded once a worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quern.config import PASSAGE_PREFIX, QUERY_PREFIX, SETTINGS
from quern.functions import text as T

BUCKETS = 256
#: Words whose bucket a worker remembers at most; frequent ones come early, and the others are hashed again.
REMEMBERED = 1 << 17


class Embedder(Protocol):
    prefixed: bool

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Bucket of a word: the first 8 hex digits of its md5, modulo the width. Counts, scaled to length 1."""

    prefixed = False

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.memory: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        got = self.memory.get(word)
        if got is None:
            got = int.from_bytes(hashlib.md5(word.encode()).digest()[:4]) % self.buckets
            if len(self.memory) < REMEMBERED:
                self.memory[word] = got
        return got

    def at(self, words: list[str]) -> np.ndarray:
        """The bucket of each word."""
        return np.array([self._bucket(w) if b is None else b for w, b in zip(words, map(self.memory.get, words), strict=True)], np.int64)

    def counted(self, at: np.ndarray, n: Sequence[int]) -> np.ndarray:
        """The vectors of texts of ``n`` words each, whose buckets follow each other in ``at``."""
        cells = np.repeat(np.arange(len(n)) * self.buckets, n) + at
        out = np.bincount(cells, minlength=len(n) * self.buckets).reshape(len(n), self.buckets).astype(float)
        return out / np.sqrt(np.maximum((out**2).sum(1, keepdims=True), 1))

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = [t.split() for t in texts]
        return self.counted(self.at([w for p in parts for w in p]), np.array([len(p) for p in parts], np.int64))


class SentenceModel:
    """A sentence-transformers model from local files, or downloaded where that is possible."""

    prefixed = True

    def __init__(self, name: str = SETTINGS.embedding_model, device: str = SETTINGS.embedding_device):
        from sentence_transformers import SentenceTransformer

        try:
            self.model = SentenceTransformer(name, device=device, local_files_only=True)
        except Exception:  # noqa: BLE001  whatever local loading lacks, a download may have
            self.model = SentenceTransformer(name, device=device)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.model.encode(texts, normalize_embeddings=True)


_loaded: dict[tuple, Embedder] = {}


def loaded(make: Callable[..., Embedder], *args) -> Embedder:
    """One instance a worker for each maker and its arguments."""
    key = (make, args)
    if key not in _loaded:
        _loaded[key] = make(*args)
    return _loaded[key]


def _embed(column: Column, prefix: str, make: Callable[..., Embedder], args: tuple) -> Column:
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(make, *args)
        for s in parts:
            yield pd.Series(list(model(s.fillna("").tolist())), dtype=object)

    return run(T.with_prefix(column, prefix) if make.prefixed else column)


def passages(column: Column, make: Callable[..., Embedder] = HashEmbedder, *args) -> Column:
    return _embed(column, PASSAGE_PREFIX, make, args)


def questions(column: Column, make: Callable[..., Embedder] = HashEmbedder, *args) -> Column:
    return _embed(column, QUERY_PREFIX, make, args)


#: How a word's bucket is written where a page holds those of all its words: any windows of them are then embedded without hashing words again.
CODE = np.dtype(np.min_scalar_type(BUCKETS - 1)).newbyteorder("<")


def word_buckets(words: list[str]) -> bytes:
    return loaded(HashEmbedder).at(words).astype(CODE).tobytes()


def buckets_slice(column: Column, start: Column, size: int) -> Column:
    """The buckets of the words from ``start`` on, ``size`` of them at most."""
    return F.substring(column, start * CODE.itemsize + 1, F.lit(size * CODE.itemsize))


@F.arrow_udf(ArrayType(DoubleType()))
def of_buckets(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What ``passages`` gives for a text, from its words' buckets."""
    model = loaded(HashEmbedder)
    for s in parts:
        n = pc.fill_null(pc.binary_length(s), 0).to_numpy() // CODE.itemsize
        out = model.counted(np.frombuffer(b"".join(s.drop_null().to_pylist()), CODE), n)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * model.buckets, pa.int32()), pa.array(out.ravel()))
