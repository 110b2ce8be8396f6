"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document is the set of its distinct 5-word shingles, as 64-bit hashes; a text of fewer words is one shingle.
Equal sets are one class, and one of its documents stands for it. Two classes link if 100 times the intersection
is at least 80 times the union. The join is exact:

1. One pass over the texts writes each document's class, its size and a parity bitmap of its shingles, and counts
   how many documents hold each shingle that comes first by hash. The most frequent shingles, HEAVY_MAX at most,
   go last in every document's order, so that common lines and passages don't bring documents together.
2. Sets of n shingles can only link if they share one of the first n - ceil(0.8 n) + 1 in that order. A second pass
   deals these out by column blocks. In each block, the sets that hold a shingle are paired where sizes and
   positions allow it, and parity bitmaps that differ in more bits than the sizes allow discard a pair. Long columns
   give a chain over sizes instead of all pairs.
3. Components of these pairs are the row blocks: no link leaves one. A third pass fetches the sets of their members
   only, and each block is multiplied in tiles of rows and column stripes: overlaps accumulate in a dense tile, a pair is
   given up once what is left of its rows can't reach the bound, and rows that are connected already are skipped.
   A component too large for a task is cut by size class and hash, and a few of its members, the pivots of their size
   class, go to every piece: near copies of one text are connected by them, with each other member in one task only. What
   that leaves unconnected is an outsider; only outsiders are copied, to every piece that may hold a link to one of them.
4. Components of the links name the result.

Nothing is capped: the limits choose between ways that give the same links. A row is known by its place, the file and
the number in it, so ids may be of any type, missing or repeated. Defined results: a null or empty text, or one without
words, has size 0 and is its own component; a null id counts as the smallest; rows that share an id are one node;
other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.bpe import Remembered
from quern.llm.common import materialize, remember, ship, table
from quern.llm.components import components

WORDS = 5
PERCENT = 80
HEAVY_MIN = 12
HEAVY_MAX = 1 << 17
ROWS_PER_BLOCK = 2000
MIN_BLOCKS = 16
FLUSH = 1 << 18
PAIRED = 64
BITMAP, BITMAP_MAX = 512, 1 << 16
BLOOM_BITS = 1 << 26
TASK_TOKENS = 1_500_000
TASK_ROWS = 2048
TILE, STRIPE = 256, 4096
#: Pivots of a size class of a component that is cut, about; fewer of long texts.
PIVOTS = 128

_U = np.uint64
_word = Remembered(xxhash.xxh64_intdigest, 100_000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split()  # bytes: A-Z only, and white space is 09-0D and 20
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_word.__getitem__, words), np.uint64, n)
    size = min(n, WORDS)
    h = _mix(w[: n - size + 1] + _U(size))
    for k in range(1, size):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[k : n - size + 1 + k])
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) > 1 else h


def parity(h: np.ndarray) -> bytes:
    """Bit b: whether an odd number of the hashes end in b. As many bits as shingles, about, and a power of two.

    Sets that differ in d shingles have bitmaps that differ in d bits at most, also after both are folded."""
    size = min(max(BITMAP, 1 << (len(h) - 1).bit_length()), BITMAP_MAX) if len(h) else BITMAP
    return np.packbits(np.bincount((h & _U(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    return n - -(-n * PERCENT // 100) + 1


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of these sizes: 100 i >= 80 (a + b - i)."""
    return -(-(a + b) * PERCENT // (100 + PERCENT))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class _Blocks:
    """Collects columns of numbers and deals them out by column block, as rows of raw bytes."""

    def __init__(self, blocks: int, names: tuple[str, ...]):
        self.blocks, self.names, self.held, self.n = blocks, names, [], 0

    def add(self, *cols: np.ndarray) -> None:
        self.held.append(cols)
        self.n += len(cols[0])

    def flush(self) -> dict[str, list]:
        cols = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        block = (cols[0] % _U(self.blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        cols = [c[order] for c in cols]
        block = block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[starts[1:], len(block)]
        out = {"block": block[starts].tolist()}
        for name, c in zip(self.names, cols, strict=True):
            out[name] = [c[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        self.held, self.n = [], 0
        return out


def _texts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _placed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``docs`` as a Parquet table, and for each row its place: a hash of the file's path, and the row's number in it.

    A plain Parquet scan is used as it is, and anything else is written first."""
    plan = docs._jdf.queryExecution().analyzed()
    relation = plan.relation() if plan.getClass().getSimpleName() == "LogicalRelation" else None
    if relation is None or relation.getClass().getSimpleName() != "HadoopFsRelation" or "Parquet" not in relation.fileFormat().toString():
        docs = materialize(spark, docs, "rows")
    held = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(held["file_path"]), held["row_index"]


def _rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """id, text, file, at."""
    docs, file, at = _placed(spark, docs)
    return docs.select(F.col("doc_id").alias("id"), "text", file.alias("file"), at.alias("at"))


_NUMBERS = ("file", "at", "n", "k1", "k2")


def _first_pass(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows of documents (class and size), and rows of first shingles by column block."""
    kind = docs.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), *((c, pa.int64()) for c in _NUMBERS), ("bits", pa.binary()), ("block", pa.int32()), ("tokens", pa.binary())])

    def run(batches):
        remember("jaccard", _word.clear)
        seen: set[int] = set()
        dealt = _Blocks(blocks, ("tokens",))
        out: dict[str, list] = {k: [] for k in ("id", *_NUMBERS, "bits")}

        def documents():
            n = len(out["id"])
            return pa.RecordBatch.from_pydict(out | {"block": [None] * n, "tokens": [None] * n}, schema=schema)

        def firsts():
            got = dealt.flush()
            none = [None] * len(got["block"])
            return pa.RecordBatch.from_pydict({k: none for k in out} | got, schema=schema)

        for id_, text, file, at in _texts(batches):
            h = shingles(text or "")
            n = len(h)
            k1, k2 = (int.from_bytes(d, "little", signed=True) for d in _halves(h)) if n else (0, 0)
            for name, v in zip(out, (id_, file, at, n, k1, k2, parity(h)), strict=True):
                out[name].append(v)
            if n and k1 not in seen:
                seen.add(k1)
                dealt.add(h[: prefix_length(n)])
                if dealt.n >= FLUSH:
                    yield firsts()
            if len(out["id"]) >= 4096:
                yield documents()
                for v in out.values():
                    v.clear()
        if out["id"]:
            yield documents()
        if dealt.n:
            yield firsts()

    names = ", ".join(f"{c} long" for c in _NUMBERS)
    return docs.mapInArrow(run, f"id {kind.simpleString()}, {names}, bits binary, block int, tokens binary")


def _halves(h: np.ndarray) -> tuple[bytes, bytes]:
    d = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
    return d[:8], d[8:]


def _frequent(blob: pd.DataFrame) -> pd.DataFrame:
    tokens, counts = np.unique(np.frombuffer(b"".join(blob["tokens"]), np.uint64), return_counts=True)
    keep = counts >= HEAVY_MIN
    return pd.DataFrame({"token": _signed(tokens[keep]), "held": counts[keep]})


def _ordered(h: np.ndarray, heavy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A set in the order shared by all: rare shingles by hash, then frequent ones by how many hold them."""
    if not len(heavy):
        return h
    at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
    hit = heavy[at] == h
    if not hit.any():
        return h
    return h[np.lexsort((h, np.where(hit, weight[at], 0)))]


_POSTINGS = "block int, tokens binary, keys binary, sizes binary, places binary"


def _second_pass(docs: DataFrame, blocks: int, heavy, weight) -> DataFrame:
    schema = pa.schema([("block", pa.int32()), *((k, pa.binary()) for k in ("tokens", "keys", "sizes", "places"))])
    held = docs.sparkSession.sparkContext.broadcast((heavy, weight))

    def run(batches):
        remember("jaccard", _word.clear)
        heavy, weight = held.value
        seen: set[int] = set()
        dealt = _Blocks(blocks, ("tokens", "keys", "sizes", "places"))
        for _, text, _, _ in _texts(batches):
            h = shingles(text or "")
            n = len(h)
            if not n:
                continue
            k1 = int.from_bytes(_halves(h)[0], "little", signed=True)
            if k1 in seen:
                continue
            seen.add(k1)
            p = prefix_length(n)
            dealt.add(_ordered(h, heavy, weight)[:p], np.full(p, k1), np.full(p, n, np.uint32), np.arange(p, dtype=np.uint32))
            if dealt.n >= FLUSH:
                yield pa.RecordBatch.from_pydict(dealt.flush(), schema=schema)
        if dealt.n:
            yield pa.RecordBatch.from_pydict(dealt.flush(), schema=schema)

    return docs.mapInArrow(run, _POSTINGS)


def _pairs(blob: pd.DataFrame) -> pd.DataFrame:
    """Pairs of classes that meet in this column block; ``chained`` ones connect a long column and aren't tested."""
    token = np.frombuffer(b"".join(blob["tokens"]), np.uint64)
    key = np.frombuffer(b"".join(blob["keys"]), np.int64)
    size = np.frombuffer(b"".join(blob["sizes"]), np.uint32).astype(np.int64)
    place = np.frombuffer(b"".join(blob["places"]), np.uint32).astype(np.int64)
    order = np.lexsort((key, size, token))
    token, key, size, place = token[order], key[order], size[order], place[order]
    fresh = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
    token, key, size, place = token[fresh], key[fresh], size[fresh], place[fresh]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[start, len(token)])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for m in np.unique(length[(length > 1) & (length <= PAIRED)]):
        i, j = np.triu_indices(m, 1)
        s = start[length == m][:, None]
        a, b = (s + i).ravel(), (s + j).ravel()  # sizes rise within a column, so a's is the smaller
        fits = 100 * size[a] >= PERCENT * size[b]
        fits &= 1 + np.minimum(size[a] - place[a] - 1, size[b] - place[b] - 1) >= overlap_bound(size[a], size[b])
        found.append((key[a[fits]], key[b[fits]], np.zeros(fits.sum(), bool)))
    for s, m in zip(start[length > PAIRED], length[length > PAIRED], strict=True):
        a = np.arange(s, s + m - 1)
        a = a[100 * size[a] >= PERCENT * size[a + 1]]
        found.append((key[a], key[a + 1], np.ones(len(a), bool)))
    if not found:
        return pd.DataFrame({"a": [], "b": [], "chained": []}).astype({"a": "int64", "b": "int64", "chained": "bool"})
    a, b, chained = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "chained": chained}).groupby(["a", "b"], as_index=False)["chained"].any()


def _near(batches):
    """Pairs whose bitmaps differ in no more bits than linked sets of their sizes may, and chained ones."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("a", "b", "chained", "na", "nb", "bits_a", "bits_b")]
        kept = [
            (a, b)
            for a, b, chained, na, nb, x, y in zip(*cols, strict=True)
            if chained or bits_apart(x, y) <= na + nb - 2 * overlap_bound(na, nb)
        ]
        if kept:
            yield pa.RecordBatch.from_pydict({"a": [k[0] for k in kept], "b": [k[1] for k in kept]})


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self, at: np.ndarray) -> np.ndarray:
        return np.array([self.find(x) for x in at.tolist()])


def multiply(sets: list[np.ndarray], side: np.ndarray, crossed: bool, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect the linked sets: of all pairs, or (crossed) of pairs with one set on each side.

    Sets of one label are connected from the start. Rows are taken by size, in tiles; a tile pair whose sizes can't link is skipped, and so are connected rows.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    tokens = np.concatenate([sets[i] for i in order])
    row = np.repeat(np.arange(len(order)), size)
    _, column, held = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    by = np.lexsort((column, row))
    row, column = row[by], column[by]
    width = int(column.max()) + 1 if len(column) else 0
    begin = np.searchsorted(row, np.arange(len(order) + 1))
    side = side[order]
    forest = _Forest(len(order))
    if label is not None:
        first: dict[int, int] = {}
        for k, x in enumerate(label[order].tolist()):
            forest.join(first.setdefault(x, k), k)
    stripes = np.arange(0, width, STRIPE)

    def dense(lo: int, hi: int, c0: int) -> np.ndarray:
        out = np.zeros((hi - lo, min(STRIPE, width - c0)), np.float32)
        r, c = row[begin[lo] : begin[hi]], column[begin[lo] : begin[hi]]
        own = (c >= c0) & (c < c0 + STRIPE)
        out[r[own] - lo, c[own] - c0] = 1
        return out

    tiles = [(k, min(k + TILE, len(order))) for k in range(0, len(order), TILE)]
    for x, (lo, hi) in enumerate(tiles):
        for lo2, hi2 in tiles[x:]:
            if 100 * size[hi - 1] < PERCENT * size[lo2]:
                break
            a, b = np.arange(lo, hi)[:, None], np.arange(lo2, hi2)[None, :]
            alive = (a < b) & (100 * np.minimum(size[a], size[b]) >= PERCENT * np.maximum(size[a], size[b]))
            if crossed:
                alive &= side[a] != side[b]
            alive &= forest.roots(a.ravel())[:, None] != forest.roots(b.ravel())[None, :]
            if not alive.any():
                continue
            need = overlap_bound(size[a], size[b])
            overlap = np.zeros(alive.shape, np.float32)
            left_a = (begin[lo + 1 : hi + 1] - begin[lo:hi]).astype(np.int64)
            left_b = (begin[lo2 + 1 : hi2 + 1] - begin[lo2:hi2]).astype(np.int64)
            for c0 in stripes:
                p = dense(lo, hi, c0)
                q = p if (lo2, hi2) == (lo, hi) else dense(lo2, hi2, c0)
                overlap += p @ q.T
                left_a -= p.sum(1).astype(np.int64)
                left_b -= q.sum(1).astype(np.int64)
                alive &= overlap + np.minimum(left_a[:, None], left_b[None, :]) >= need
                if not alive.any():
                    break
            for i, j in np.argwhere(alive & (overlap >= need)).tolist():
                forest.join(lo + i, lo2 + j)
    return [(int(order[i]), int(order[r])) for i in range(len(order)) if (r := forest.find(i)) != i]


def _links(blob: pd.DataFrame) -> pd.DataFrame:
    """Edges between classes, which ids can't name: several classes may hold one id."""
    a, b = [], []
    for _, task in blob.groupby("task", sort=False):
        task = task.drop_duplicates(["k1", "side"])
        crossed = bool(task["crossed"].iloc[0])
        key = task["k1"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in task["tokens"]]
        for i, j in multiply(sets, task["side"].to_numpy(), crossed, task["label"].to_numpy()):
            a.append(key[i])
            b.append(key[j])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _bloom_place(file: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _mix(file.view(np.uint64) ^ _mix(at.view(np.uint64))) & _U(BLOOM_BITS - 1)


def _bloom(members: DataFrame) -> np.ndarray:
    """Bits of a bounded filter of rows: BLOOM_BITS, whatever their number. A full one lets more pass, no fewer."""

    def run(batches):
        for batch in batches:
            at = _bloom_place(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_pydict({"word": (at >> _U(6)).astype(np.int64), "bits": _signed(_U(1) << (at & _U(63)))})

    words = members.select("file", "at").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(BLOOM_BITS >> 6, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _third_pass(docs: DataFrame, members: DataFrame) -> DataFrame:
    """file, at and tokens of the documents that may stand for one of the classes in ``members``."""
    schema = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("tokens", pa.binary())])
    held = docs.sparkSession.sparkContext.broadcast(_bloom(members))

    def run(batches):
        remember("jaccard", _word.clear)
        bloom = held.value
        for batch in batches:
            file, row = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            at = _bloom_place(file, row)
            may = np.flatnonzero((bloom[at >> _U(6)] >> (at & _U(63))) & _U(1))
            for lo in range(0, len(may), 512):
                own = may[lo : lo + 512]
                sets = [shingles(t or "").tobytes() for t in batch.column(1).take(pa.array(own)).to_pylist()]
                yield pa.RecordBatch.from_pydict({"file": file[own], "at": row[own], "tokens": sets}, schema=schema)

    return docs.mapInArrow(run, "file long, at long, tokens binary")


_TASK = ("file", "at", "k1", "label", "task", "side", "crossed")


def _parts(tokens: str, rows: str) -> Column:
    """Pieces of half a task's size at most, by size and by rows."""
    return F.greatest(F.ceil(F.col(tokens) * 2 / TASK_TOKENS), F.ceil(F.col(rows) * 2 / TASK_ROWS)).cast("int")


def _sized(members: DataFrame) -> DataFrame:
    """``members`` with class: sizes of linked sets are in the same or in neighbouring classes.

    A little over the ratio of two linked sizes, so that rounding can't part them by two classes."""
    return members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT * 1.0001))).cast("int"))


def _first_tasks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_TASK of each member, and the members of components that are cut.

    A component that fits goes to one task. Of a larger one, each member goes to one piece of its size class, and pivots
    go to all pieces of their own and of the neighbouring classes."""
    totals = members.groupBy("component", "class").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    whole = totals.groupBy("component").agg(F.sum("tokens").alias("all_tokens"), F.sum("rows").alias("all_rows"))
    whole = whole.select("component", ((F.col("all_tokens") <= TASK_TOKENS) & (F.col("all_rows") <= TASK_ROWS)).alias("fits"))
    rows = members.join(whole, "component")
    none = F.lit(0).alias("side"), F.lit(False).alias("crossed")
    fitting = rows.where("fits").select("file", "at", "k1", F.col("k1").alias("label"), F.xxhash64("component").alias("task"), *none)
    cut = rows.where("not fits").drop("fits")
    pieces = totals.withColumn("parts", _parts("tokens", "rows"))
    # As many pivots as keep to a quarter of a task, about, whatever the texts' lengths.
    few = F.greatest(F.lit(4), F.least(F.lit(PIVOTS), F.floor(F.col("rows") * TASK_TOKENS / F.col("tokens") / 16)))
    pieces = pieces.withColumn("pivots", few)
    met = cut.join(pieces.select("component", "class", "parts", "rows", "pivots"), ["component", "class"])
    own = met.select("file", "at", "k1", F.col("k1").alias("label"), F.xxhash64("component", "class", F.pmod(F.xxhash64("k1"), "parts").cast("int")).alias("task"), *none)
    chosen = met.where(F.pmod(F.xxhash64("k1", F.lit("pivot")), "rows") < F.col("pivots"))
    chosen = chosen.select("file", "at", "k1", "component", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class"))
    chosen = chosen.join(pieces.select("component", "class", "parts"), ["component", "class"])
    chosen = chosen.select("file", "at", "k1", "component", "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pivots = chosen.select("file", "at", "k1", F.col("k1").alias("label"), F.xxhash64("component", "class", "part").alias("task"), *none)
    return fitting.unionByName(own).unionByName(pivots).distinct(), cut


def _second_tasks(cut: DataFrame) -> DataFrame:
    """_TASK for the pairs of unlike labels that are left in components that were cut (with label).

    The label with the most rows is the core. Outsiders meet each other and the core, piece by piece; the core's rows never
    meet each other, and are copied as often only as there are pieces of outsiders."""
    sizes = cut.groupBy("component", "label").agg(F.count("*").alias("held"))
    core = sizes.groupBy("component").agg(F.max(F.struct("held", "label")).alias("most"), F.count("*").alias("labels"))
    rows = cut.join(core.where("labels > 1").select("component", F.col("most.label").alias("core")), "component")
    rows = rows.withColumn("out", F.col("label") != F.col("core"))
    counts = rows.groupBy("component", "class", "out").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    counts = counts.groupBy("component", "out").agg(F.max("tokens").alias("tokens"), F.max("rows").alias("rows")).withColumn("parts", _parts("tokens", "rows"))
    parts = counts.groupBy("component").agg(*[F.coalesce(F.max(F.when(F.col("out") == o, F.col("parts"))), F.lit(0)).alias(c) for c, o in (("out_parts", True), ("core_parts", False))])
    rows = rows.join(parts, "component")
    own = F.pmod(F.xxhash64("k1"), F.when(F.col("out"), F.col("out_parts")).otherwise(F.col("core_parts"))).cast("int")

    def piece(size: Column, out: Column, part: Column) -> Column:
        return F.named_struct(F.lit("class"), size, F.lit("out"), out, F.lit("part"), part)


    # A component with more than one label has rows of both kinds. Pieces of the core go by -1, -2 and so on.
    outsiders = F.sequence(F.lit(0), F.col("out_parts") - 1)
    met = F.when(F.col("out"), F.concat(outsiders, F.sequence(-F.col("core_parts"), F.lit(-1)))).otherwise(outsiders)
    rows = rows.select("file", "at", "k1", "label", "component", "class", piece(F.col("class"), F.col("out"), own).alias("mine"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step"), met.alias("met"))
    rows = rows.select("*", F.explode("met").alias("other"))
    part = F.when(F.col("other") >= 0, F.col("other")).otherwise(-1 - F.col("other")).cast("int")
    theirs = piece(F.col("class") + F.col("step"), F.col("other") >= 0, part)
    rows = rows.withColumn("theirs", theirs)
    low, high = F.least("mine", "theirs"), F.greatest("mine", "theirs")
    side = F.when(F.col("mine") <= F.col("theirs"), 0).otherwise(1)
    return rows.select("file", "at", "k1", "label", F.xxhash64("component", low, high).alias("task"), side.alias("side"), (F.col("mine") != F.col("theirs")).alias("crossed"))


def _product(spark: SparkSession, docs: DataFrame, wanted: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (a, b) of the tasks' links, as a written table."""
    sets = _third_pass(docs, members)
    slots = max(1, int(members.agg(F.sum("n")).first()[0] or 0) // (TASK_TOKENS // 4))
    tasks = wanted.join(sets, ["file", "at"]).withColumn("slot", F.pmod("task", F.lit(slots)))
    links = tasks.select("slot", "task", "k1", "label", "side", "crossed", "tokens").groupBy("slot").applyInPandas(_links, "a long, b long")
    return materialize(spark, links, "links")


def _linked(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, file, at, n, k1, k2), classes (k1, k2, n, id, file and at of the row that stands for it) and links of classes by k1.

    ``docs``: id, text, file, at."""
    ship(spark)
    blocks = max(MIN_BLOCKS, docs.count() // ROWS_PER_BLOCK)
    first = materialize(spark, _first_pass(docs, blocks), "shingles")
    rows = first.where("block is null").select("id", *_NUMBERS, "bits")
    least = F.min(F.struct("id", "file", "at")).alias("least")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(least, F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = materialize(spark, classes.select("k1", "k2", "least.id", "least.file", "least.at", "n", "bits"), "classes")
    frequent = first.where("block is not null").select("block", "tokens").groupBy("block").applyInPandas(_frequent, "token long, held long")
    heavy = frequent.orderBy(F.desc("held"), "token").limit(HEAVY_MAX).toPandas()
    token, held = heavy["token"].to_numpy(np.int64).view(np.uint64), heavy["held"].to_numpy(np.int64)
    order = np.argsort(token)

    pairs = _second_pass(docs, blocks, token[order], held[order]).groupBy("block").applyInPandas(_pairs, "a long, b long, chained boolean")
    pairs = materialize(spark, pairs.groupBy("a", "b").agg(F.max("chained").alias("chained")), "pairs")
    sides = classes.select("k1", "n", "bits")
    met = pairs.join(sides.toDF("a", "na", "bits_a"), "a").join(sides.toDF("b", "nb", "bits_b"), "b")
    near = met.mapInArrow(_near, "a long, b long")

    groups = components(spark, near)
    members = classes.join(groups.toDF("k1", "component"), "k1").select("file", "at", "k1", "n", "component")
    members = materialize(spark, _sized(members), "members")
    wanted, cut = _first_tasks(members)
    links = _product(spark, docs, wanted, members)
    cut = materialize(spark, cut, "cut")
    if not cut.isEmpty():
        labels = components(spark, links).toDF("k1", "label")
        cut = cut.join(labels, "k1", "left").withColumn("label", F.coalesce("label", "k1"))
        wanted = materialize(spark, _second_tasks(cut), "unlike")
        left = members.join(wanted.select("k1").distinct(), "k1", "left_semi")
        links = links.unionByName(_product(spark, docs, wanted, left))
    return rows.drop("bits"), classes.drop("bits"), links


def survivors(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """file and at of one row of each group of linked texts, the one with the least id; ids play no part in what is a group.

    ``docs``: id, text, file, at. Rows without words link with nothing, so all of them stay."""
    rows, classes, links = _linked(spark, docs)
    named = classes.join(components(spark, links).toDF("k1", "component"), "k1", "left")
    # A class without links is a group by itself, under its whole key.
    group = F.coalesce("component", "k1").alias("g1"), F.when(F.col("component").isNull(), F.col("k2")).alias("g2")
    kept = named.groupBy(*group).agg(F.min(F.struct("id", "file", "at")).alias("least")).select("least.file", "least.at")
    return kept.unionByName(rows.where("n = 0").select("file", "at"))


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group of linked texts, with all columns of ``docs``; what links with nothing stays.

    A group's row is the one with the least id, null before all, then by place. Equal or missing ids alone drop nothing;
    rows that are equal in all columns and have words are one group; null texts and texts without words stay, repeated
    ones too; an empty table gives an empty result; other columns may have any names."""
    docs, file, at = _placed(spark, docs)
    kept = materialize(spark, survivors(spark, docs.select(F.col("doc_id").alias("id"), "text", file.alias("file"), at.alias("at"))), "groups")
    names = []
    while len(names) < 4:
        names.append(next(n for k in range(len(docs.columns) + 8) if (n := f"place_{k}") not in {c.lower() for c in docs.columns} | set(names)))
    # The same plan at every size: these keys grow with the input, so they are never broadcast, and texts aren't sorted.
    kept = kept.select(F.col("file").alias(names[2]), F.col("at").alias(names[3])).hint("shuffle_hash")
    left = docs.select("*", file.alias(names[0]), at.alias(names[1]))
    return left.join(kept, (F.col(names[0]) == F.col(names[2])) & (F.col(names[1]) == F.col(names[3])), "left_semi").drop(*names[:2])


def join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    rows, classes, links = _linked(spark, _rows(spark, docs))
    # Classes that share an id are one node.
    held = rows.where("n > 0").select("id", "k1")
    hubs = held.groupBy("id").agg(F.min("k1").alias("hub"), F.max("k1").alias("far")).where("hub < far").select(F.col("id").alias("hub_id"), "hub")
    same = held.join(hubs, F.col("id").eqNullSafe(F.col("hub_id"))).where("k1 != hub").select(F.col("k1").alias("a"), F.col("hub").alias("b")).distinct()
    named = classes.join(components(spark, links.unionByName(same)).toDF("k1", "group"), "k1", "left").select("k1", "k2", F.struct("id").alias("own"), "group")
    least = named.where("group is not null").groupBy("group").agg(F.min("own").alias("least"))
    # In structs a missing id is a value, smaller than all others, and no gap to fill.
    named = named.join(least, "group", "left").select("k1", "k2", F.coalesce("least", "own").alias("component"))
    out = rows.join(named, ["k1", "k2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component.id")).alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, table(spark, sf_dir, "documents"))
