"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Two lexicons are learned first, of words and of word beginnings that toxic rows of a bounded sample hold far more
often than others. Each text then becomes a short vector: densities of both lexicons, their hits beside words of
the second person, capitals, punctuation, repeated letters and letters mixed with digits or signs. Boosted trees
on logistic loss learn from those of the sample, and isotonic regression on rows kept aside maps their sums to
shares of toxic rows. Scoring reads every whole text once.

The sample: at most MAX_TRAIN labels, those with the smallest hash of their id, each with one row that has this id (of
several, the one whose text has the least hash); rows whose crc32 of the id as text is divisible by 5 are held out and never taken. Of it only feature vectors and
the lexicons, LEXICON words and as many beginnings that MIN_DOCS toxic rows hold at least, reach the driver. Counts that
grow with a text's length stop at MOST_HITS hits and MOST_WEIGHT of weight, so that long texts aren't toxic for their length.

Defined results: a null or empty text has features of 0 and is scored like any other; labels that are null or of
ids that ``docs`` lacks teach nothing; without labelled rows of both kinds every score is the share of toxic ones
(0 without any); equal texts score alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import map_batches, materialize, remember, table

MAX_TRAIN = 12_000
LEXICON = 2000
PREFIX = 5
MIN_DOCS = 3
MOST_HITS, MOST_WEIGHT = 50, 200.0
TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 80, 3, 0.15, 32, 5, 1.0

#: Words of the second person in the languages at hand (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer tú ti tus usted ustedes vosotros vuestro".split()
)
REACH = 5
FEATURES = (
    "words", "lexicon_share", "lexicon_hits", "lexicon_kinds", "lexicon_weight", "prefix_share", "prefix_hits", "prefix_weight",
    "near_person", "person_share", "capitals", "capital_words", "punctuation", "bangs", "repeated", "mixed", "masked",
)

_UPPER = bytes(range(65, 91))
_PUNCTUATION = b"!?.,;:'\"()-"
_STRIP = "!?.,;:'\"()-*#$%&"
_REPEATED = re.compile(r"([a-z])\1\1")
_MIXED = re.compile(r"[A-Za-z][0-9@$][A-Za-z]")
_MASKED = re.compile(r"[A-Za-z][*#_.]+[A-Za-z]")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    return [w.strip(_STRIP) for w in text.lower().split()]


def vector(text: str, lexicon: dict[str, float], prefixes: dict[str, float]) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    words = words_of(text)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    begins = [p for w in words if (p := w[:PREFIX]) in prefixes]
    person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and person:
        at = np.array(person)
        where = np.searchsorted(at, hits)
        left, right = at[np.maximum(where - 1, 0)], at[np.minimum(where, len(at) - 1)]
        near = int((np.minimum(abs(left - hits), abs(right - hits)) <= REACH).sum())
    data = text.encode()
    size = len(data)
    return [
        float(np.log1p(n)),
        len(hits) / n,
        min(len(hits), MOST_HITS),
        len({words[i] for i in hits}),
        min(sum(lexicon[words[i]] for i in hits), MOST_WEIGHT),
        len(begins) / n,
        min(len(begins), MOST_HITS),
        min(sum(prefixes[p] for p in begins), MOST_WEIGHT),
        near,
        len(person) / n,
        (size - len(data.translate(None, _UPPER))) / size,
        sum(map(str.isupper, raw)) / n,
        (size - len(data.translate(None, _PUNCTUATION))) / size,
        data.count(b"!") / n,
        len(_REPEATED.findall(text)) / n,
        len(_MIXED.findall(text)) / n,
        len(_MASKED.findall(text)) / n,
    ]


@dataclass
class Trees:
    """Boosted trees of one depth, in arrays: a node's children are 2k+1 and 2k+2, a leaf's feature is -1."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                at = np.where(inner, 2 * at + 1 + (x[rows, f[at]] > t[at]), at)
            out += v[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting on logistic loss over histograms of quantile bins."""
    rows, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(width)]
    # Rare features are 0 nearly everywhere: their quantiles say nothing, so quantiles of the rest are added.
    cuts = [np.unique(np.r_[c, 0.0, np.quantile(x[x[:, j] != 0, j], np.arange(0, 16) / 16)]) if (x[:, j] != 0).any() else c for j, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    most = max(map(len, cuts)) + 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(rows, base)
    nodes = 2 ** (DEPTH + 1) - 1
    out = Trees(base, np.full((TREES, nodes), -1), np.zeros((TREES, nodes)), np.zeros((TREES, nodes)))
    flat = bins + np.arange(width) * most
    for k in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(rows, np.int64)
        for node in range(nodes):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            sum_g, sum_h = g[own].sum(), h[own].sum()
            out.value[k, node] = -RATE * sum_g / (sum_h + L2)
            if node >= nodes // 2 or len(own) < 2 * MIN_LEAF:
                continue
            cells = flat[own].ravel()
            hist = [np.bincount(cells, np.repeat(z, width), width * most).reshape(width, most).cumsum(1) for z in (g[own], h[own], np.ones(len(own)))]
            left_g, left_h, left_n = hist
            right_g, right_h = sum_g - left_g, sum_h - left_h
            gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - sum_g**2 / (sum_h + L2)
            gain[(left_n < MIN_LEAF) | (len(own) - left_n < MIN_LEAF)] = -1
            j, b = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                continue
            out.feature[k, node], out.threshold[k, node] = j, cuts[j][b]
            at[own] = 2 * node + 1 + (bins[own, j] > b)
        score += out.value[k][at]
    return out


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising steps from raw sums to shares, each drawn a little to one half."""
    # Equal sums are one point; pooled one by one they would draw in neighbours that their share as a whole doesn't.
    values, at = np.unique(raw, return_inverse=True)
    blocks: list[list[float]] = []  # sum of labels, rows, first raw, last raw
    for r, label, n in zip(values, np.bincount(at, y), np.bincount(at), strict=True):
        blocks.append([label, n, r, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            b = blocks[-1]
            blocks[-1] = [b[0] + a[0], b[1] + a[1], b[2], a[3]]
    at, share = [], []
    for s, n, lo, hi in blocks:
        at += [lo, hi]
        share += [(s + 0.5) / (n + 1)] * 2
    return np.array(at), np.maximum.accumulate(np.array(share))


@dataclass
class Model:
    lexicon: dict[str, float]
    prefixes: dict[str, float]
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([vector(t, self.lexicon, self.prefixes) for t in texts]).reshape(-1, len(FEATURES))
        raw = self.trees.raw(x)
        at, share = self.steps
        # A trace of the raw sum keeps the order within a step without leaving 0 to 1.
        return np.clip(0.999 * np.interp(raw, at, share) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def _lexicons(sample: DataFrame, toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """The LEXICON words, and as many beginnings, with the highest log odds between toxic rows and others."""

    def terms(batch):
        words, begins, toxic_, part = [], [], [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = {w for w in words_of(text or "") if len(w) > 2}
            for kind, found in ((0, own), (1, {w[:PREFIX] for w in own if len(w) > PREFIX})):
                words += found
                begins += [kind] * len(found)
                toxic_ += [label] * len(found)
        yield {"term": words, "kind": begins, "toxic": toxic_}

    counts = map_batches(sample, terms, "term string, kind int, toxic int").groupBy("kind", "term").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    weight = F.log((F.col("a") + 0.2) / (toxic + 0.4)) - F.log((F.col("b") + 0.2) / (clean + 0.4))
    counts = counts.where(f"a >= {MIN_DOCS}").withColumn("weight", weight).where("weight > 2")
    out: list[dict[str, float]] = []
    for kind in (0, 1):
        top = counts.where(f"kind = {kind}").orderBy(F.desc("weight"), F.desc("a"), "term").limit(LEXICON).collect()
        out.append({r["term"]: r["weight"] for r in top})
    return out[0], out[1]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    taught = labels.where("toxic is not null and doc_id is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    taught = taught.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "toxic").limit(max_train)
    # The ids are at most max_train, so this side is small enough to be sent to all. Of rows that share an id one teaches, which
    # tasks choose among their own before anything is shuffled.
    ids = F.broadcast(taught.select("doc_id").distinct())
    rows = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("at"), "text")).alias("row"))
    sample = rows.select("doc_id", "row.text").join(F.broadcast(taught), "doc_id")
    sample = sample.select("text", "toxic", (F.pmod(F.shiftright("h", 7), F.lit(4))).alias("quarter"))
    sample = materialize(spark, sample, "toxic-sample")
    totals = {(r["quarter"] == 0, r["toxic"]): r["n"] for r in sample.groupBy("quarter", "toxic").agg(F.count("*").alias("n")).collect()}
    sums = {label: sum(r["n"] for r in sample.where(f"toxic = {label}").agg(F.count("*").alias("n")).collect()) for label in (0, 1)}
    if not all(sums.values()):
        return Model({}, {}, None, None, float(sums[1] > 0))
    # Lexicons come from other rows than the trees: a tree that saw hits on words learned from its own rows would trust them too much.
    lexical = sample.where("quarter in (0, 1)")
    toxic, clean = (lexical.where(f"toxic = {label}").count() for label in (1, 0))
    lexicon, prefixes = _lexicons(lexical, toxic, clean)

    def features(batch):
        x = [vector(t or "", lexicon, prefixes) for t in batch.column("text").to_pylist()]
        yield {"x": x, "toxic": batch.column("toxic"), "quarter": batch.column("quarter")}

    kind = sample.schema["quarter"].dataType.simpleString()
    got = map_batches(sample.where("quarter in (2, 3)"), features, f"x array<double>, toxic int, quarter {kind}").toPandas()
    share = sums[1] / sum(sums.values())
    if got["toxic"].nunique() < 2:
        return Model(lexicon, prefixes, None, None, share)
    x, y = np.array(got["x"].tolist()), got["toxic"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    aside = np.arange(len(y)) % 3 == 0
    if len(np.unique(y[~aside])) < 2 or len(np.unique(y[aside])) < 2:
        aside = np.zeros(len(y), bool)
    trees = fit_trees(x[~aside], y[~aside])
    steps = fit_isotonic(trees.raw(x[aside] if aside.any() else x), y[aside] if aside.any() else y)
    return Model(lexicon, prefixes, trees, steps, share)


def score_documents(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    held = spark.sparkContext.broadcast(model)

    def run(batch):
        remember("toxicity", lambda: None)
        scores = held.value.score([t or "" for t in batch.column("text").to_pylist()])
        yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text", held_out().alias("held_out")), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score under one half, with all their columns."""
    held = spark.sparkContext.broadcast(model)

    def run(batch):
        remember("toxicity", lambda: None)
        scores = held.value.score([t or "" for t in batch.column("text").to_pylist()])
        kept = batch.filter(pa.array(scores < 0.5))
        yield {name: kept.column(name) for name in kept.schema.names}

    return map_batches(docs, run, docs.schema)


def op10_toxic_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(spark, docs, fit(spark, docs, table(spark, sf_dir, "labels")))
