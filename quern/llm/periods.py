"""Runs of words that repeat with a period, found by block matching, and texts with the repeats cut out.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, TIMES * q) words long, that no
neighbouring word extends with that period. Words are what ASCII white space separates. A text's words become numbers. For
each power of two L, the blocks of L words that begin at multiples of L are keys of an Aho-Corasick automaton of integer
sequences; the text is searched for all of them. A run whose period is in [L, 2L) holds an aligned block that occurs
again one period later, so an occurrence in that distance of an equal block is a seed. A seed is extended word by word in
both directions, which is exact; a stretch that is long enough and whose first period is no repetition itself is a run.

What is searched: in a run, each three words stand one period earlier as well, 3L - 2 times in a row at least. So a scale looks only
at stretches of three words that occurred less than 2L words before. That is necessary for a run, so nothing is missed;
ordinary prose has no such stretch, and no automaton is built for it.

What is not extended: a seed inside a run that is known already, whose period divides the distance; of blocks that
lie in two runs of a short period, all distances but those that bring the runs' ends or beginnings together, as at
any other the stretch would be one of the short period; and a seed inside a stretch of its distance that was just extended. Work is
therefore near linear in a text's words at each scale, however its words repeat.

Rows are worked on where they are, without a shuffle, so no key can gather rows. A task holds one group of texts of about GROUP
words, or one longer text; an automaton is built for CHUNK words, or 8 blocks where these are longer.

Defined results: null, empty and blank texts have no words, no runs and the empty text; a row without an id is like any
other; repeated rows give equal rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.common import map_batches, table

LEAST, TIMES = 6, 4
GROUP, CHUNK = 1 << 18, 1 << 16
SPACE, SPACES = " \t\n\x0b\x0c\r", "[\\x20\\x09-\\x0D]+"
_NEVER = np.iinfo(np.int64).max
Run = tuple[int, int, int]


def seeds(words: np.ndarray, lo: int, hi: int, base: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of block places j and distances d in [size, 2 * size) with ``words[j:j+size] == words[j+d:j+d+size]``.

    Blocks begin at multiples of ``size`` from ``base`` on, and they and their occurrences lie in [lo, hi).
    """
    first, last = base - (base - lo) // size * size, hi - 2 * size
    chunk = max(CHUNK // size, 8) * size
    for at in range(first, last + 1, chunk):
        places = range(at, min(at + chunk, last + 1), size)
        text = tuple(words[at : min(places[-1] + 3 * size, hi)].tolist())
        numbers: dict[tuple, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        held = np.empty(len(places), np.int64)
        for k in range(len(places)):
            key = text[k * size : (k + 1) * size]
            held[k] = number = numbers.setdefault(key, len(numbers))
            if number == len(numbers) - 1:
                automaton.add_word(key, number)
        automaton.make_automaton()
        hits = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
        begins = hits[:, 0] - (size - 1)
        block = begins // size - 1  # the one aligned block that begins between size and 2 * size - 1 words before
        inside = (block >= 0) & (block < len(places))
        begins, block, number = begins[inside], block[inside], hits[inside, 1]
        alike = held[block] == number
        j = at + block[alike] * size
        yield j, at + begins[alike] - j


def stretch(words: np.ndarray, lo: int, hi: int, j: int, d: int, size: int) -> tuple[int, int]:
    """The longest [s, e) in [lo, hi) around the seed whose words are as d words later or before."""
    end, step = j + size, 64
    while end < hi - d:
        to = min(end + step, hi - d)
        other = np.flatnonzero(words[end:to] != words[end + d : to + d])
        if other.size:
            end += int(other[0])
            break
        end, step = to, step * 2
    begin, step = j, 64
    while begin > lo:
        to = max(begin - step, lo)
        other = np.flatnonzero(words[to:begin] != words[to + d : begin + d])
        if other.size:
            begin = to + int(other[-1]) + 1
            break
        begin, step = to, step * 2
    return begin, end + d


def primitive(period: np.ndarray) -> bool:
    """Whether these words are no smaller number of words repeated."""
    left, f = len(period), 2
    while left > 1:
        f = f if f * f <= left else left
        if left % f == 0:
            part = len(period) // f
            if (period[part:] == period[:-part]).all():
                return False
            while left % f == 0:
                left //= f
        f += 1
    return True


def _known(runs: list[Run], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place in [lo, hi), which run with the farthest end begins there or before (-1: none); their begins and ends."""
    runs = sorted(((s, e) for s, e, _ in runs if e > lo and s < hi), key=lambda r: (r[1], r[0]))
    which = np.full(hi - lo, -1)
    for k, (s, _) in enumerate(runs):
        which[max(s, lo) - lo] = k  # in the order of their ends, so the farthest stays
    return np.maximum.accumulate(which), np.array([r[0] for r in runs] + [0]), np.array([r[1] for r in runs] + [-1])


def _extended(words: np.ndarray, lo: int, hi: int, runs: list[Run], parts: list[tuple[int, int]], size: int) -> None:
    """Adds the runs of the text [lo, hi) with a period in [size, 2 * size) to ``runs``, which has those of shorter ones."""
    found: dict[Run, None] = {}
    done: dict[int, int] = {}
    for a, b in parts:
        which, _, ends = _known(runs, a, b)
        if ends[which[0]] >= b:  # all of it lies in one run of a shorter period
            continue
        short, s_begins, s_ends = _known([r for r in runs if 2 * r[2] <= size], a, b)
        for j, d in seeds(words, a, b, lo, size):
            kept = ends[which[j - a]] < j + d + size
            j, d = j[kept], d[kept]
            r, q = short[j - a], short[j + d - a]
            within = (s_ends[r] >= j + size) & (s_ends[q] >= j + d + size)
            kept = ~within | (s_ends[q] - s_ends[r] == d) | (s_begins[q] - s_begins[r] == d)
            j, d = j[kept], d[kept]
            by = np.argsort(j, kind="stable")
            for at, gap in zip(j[by].tolist(), d[by].tolist(), strict=True):
                if done.get(gap, -1) >= at + gap + size:
                    continue
                begin, end = stretch(words, lo, hi, at, gap, size)
                done[gap] = end
                if end - begin >= max(LEAST, TIMES * gap) and primitive(words[begin : begin + gap]):
                    found[(begin, end, gap)] = None
    runs.extend(found)


def _before(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of three words that occurred before in their text, and how many words before; equal numbers may be chance."""
    n = len(words) - 2
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w = words.astype(np.uint64)
    key = w[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ w[2:] * np.uint64(0x165667B19E3779F9)
    key = (key ^ (key >> np.uint64(29)) ^ text[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
    bits = min(max(int(n).bit_length() + 2, 10), 22)
    drawer = (key >> np.uint64(64 - bits)).astype(np.int64)
    # In a run, each three words occur three times at least.
    often = (np.bincount(drawer, minlength=1 << bits) >= 3)[drawer] & (text[:-2] == text[2:])
    at = np.flatnonzero(often)
    by = at[np.argsort(key[at], kind="stable")]
    same = key[by[1:]] == key[by[:-1]]
    places, gaps = by[1:][same], (by[1:] - by[:-1])[same]
    order = np.argsort(places)
    return places[order], gaps[order]


def runs_of(words: np.ndarray, bounds: np.ndarray) -> dict[int, list[Run]]:
    """Runs (start, length, period), by start and period, of each text k that has any: the numbers ``bounds[k]`` to ``bounds[k + 1]``."""
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at, gap = _before(words, text)
    found: dict[int, list[Run]] = {}
    size = 1
    while len(at) and TIMES * size <= lengths.max():
        near = at[gap < 2 * size]
        cut = np.flatnonzero(np.diff(near) != 1)
        begins, ends = near[np.r_[0, cut + 1]] if len(near) else near, near[np.r_[cut, len(near) - 1]] if len(near) else near
        long = ends - begins + 1 >= (3 if size == 1 else 3 * size - 2)
        parts: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            k = int(text[a])
            parts.setdefault(k, []).append((max(int(bounds[k]), a - 2 * size + 1), min(int(bounds[k + 1]), b + 3)))
        for k, of in parts.items():
            _extended(words, int(bounds[k]), int(bounds[k + 1]), found.setdefault(k, []), of, size)
        size *= 2
    return {k: sorted((s - int(bounds[k]), e - s, q) for s, e, q in runs) for k, runs in found.items() if runs}


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run repeats: of each run, its first period stays."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(edge).tolist(), strict=False) if not n]


def _group(texts: list[bytes]) -> tuple[list, list[bytes]]:
    split = [t.split() for t in texts]  # of bytes: at ASCII white space and nothing else
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for ws in split for w in ws], np.int64)
    bounds = np.r_[0, np.cumsum([len(ws) for ws in split])].astype(np.int64)
    found = runs_of(words, bounds)
    runs = [found.get(k, []) for k in range(len(split))]
    return runs, [b" ".join(collapse(ws, r) if r else ws) for ws, r in zip(split, runs, strict=True)]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period) and the collapsed text of each row (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column(1).cast(pa.large_binary())
        sizes = (pc.fill_null(pc.binary_length(texts), 0).to_numpy() // 2).tolist()
        lo = total = 0
        for hi in range(batch.num_rows):
            total += sizes[hi]  # more than the words there are
            if total >= GROUP or hi + 1 == batch.num_rows:
                runs, collapsed = _group([t or b"" for t in texts.slice(lo, hi + 1 - lo).to_pylist()])
                listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], struct)
                yield {"doc_id": batch.column(0).slice(lo, hi + 1 - lo), "runs": listed, "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}
                lo, total = hi + 1, 0

    return map_batches(docs.select("doc_id", "text"), run, schema)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; of ids whose checksum ends in 0, the words from a place on go around the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bare = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACE))
    g = F.floor(h / 10).cast("long")
    words = docs.select("doc_id", "text", g.alias("g"), F.when((h % 10 == 0) & (bare != ""), F.split(bare, SPACES)).alias("ws"))
    n = F.size("ws").cast("long")
    words = words.select("doc_id", "text", "ws", "g", F.when(n > 0, F.col("g") % n).alias("a"), n.alias("n"))
    words = words.select("doc_id", "text", "ws", "a", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("long").alias("p"))

    def looping(w: Column, i: Column) -> Column:
        a = F.col("a")
        return F.when(i < a, w).otherwise(F.get("ws", (a + (i - a) % F.col("p")).cast("int")))

    return words.select("doc_id", F.when(F.col("ws").isNull(), F.col("text")).otherwise(F.array_join(F.transform("ws", looping), " ")).alias("text"))


def described(found: DataFrame) -> DataFrame:
    """Count, the run with the greatest length by period, and digests of what ``find_runs`` gives."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")

    def better(best: Column, r: Column) -> Column:  # in their order, so the first of equals stays
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", "runs", F.aggregate("runs", none, better).alias("best"), F.array_join(line, "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(find_runs(looped(table(spark, sf_dir, "documents"))))
