"""Exact nearest neighbours that skip what cannot be near, by clusters and the triangle inequality.

The index: centroids are fitted on a bounded sample of the vectors (SAMPLE rows of SAMPLE_NUMBERS numbers at most; they change the work, never a
result), and every vector goes to its nearest one. Vectors lie in a folder a cluster, in the order of their distance from the centroid (``away``), so a batch of
them is a ring. Beside them stands a row for each cluster: centroid, least and greatest ``away``, count.

The search, for a block of questions: first each question meets the clusters nearest to it that together hold k vectors.
Its k-th best distance there bounds what can still count. A vector v of a centroid c is at least |d(q, c) - d(c, v)| from the question q,
so a ring whose distances from c are all farther from d(q, c) than the bound holds nothing that counts. Then each folder that no question of the
block needs is left unread, and each batch is multiplied with the questions whose bound reaches its ring. What is skipped is proven to be beyond the k-th
best, ties included, so the result is that of ``retrieval.nearest``. With a gate (``max_score``) the bound is the gate's if that is less.

On the driver, and broadcast: a block's questions (BLOCK), the clusters (MOST_CLUSTERS) and one bound a question. Vectors are laid out by
ranges, so a cluster that holds a third of them, or one vector that stands a million times, spreads over many tasks.

Defined results: rows without a vector are not in the index; an index of fewer than k vectors gives them all; no questions, or an empty index, give
no rows; vectors may be of any length, but all of the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.config import SETTINGS
from quern.functions import text as T
from quern.operators import retrieval
from quern.operators.retrieval import BLOCK, DIGITS, PLACE
from quern.shared import materialize
from quern.shipping import ship

SAMPLE, SAMPLE_NUMBERS = 20_000, 1 << 21
MOST_CLUSTERS = 2048
ROUNDS = 8
#: Distances are compared with so much room for what sums of doubles lose, times the greatest length of a vector.
SLACK = 1e-6
CLUSTER = "cluster int, centroid array<double>, least double, most double, vectors long"


@dataclass(frozen=True)
class Clustered:
    """A written index: its vectors (cluster, away, place, embedding) and, as arrays, its clusters."""

    vectors: DataFrame
    place: tuple[str, ...]
    clusters: np.ndarray
    centroids: np.ndarray
    least: np.ndarray
    most: np.ndarray
    counts: np.ndarray


def _matrix(rows: list, width: int | None = None) -> np.ndarray:
    return np.array(rows, dtype=np.float64).reshape(len(rows), -1 if len(rows) else width or 0)


def _gathered(rows: DataFrame, width: int) -> tuple[np.ndarray, pa.Table]:
    """The vectors of a bounded frame on the driver, as plain numbers, and its rows."""
    held = rows.toArrow()
    flat = held.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(held.num_rows, -1 if held.num_rows else width), held


def _nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1)[None, :] - 2 * (vectors @ centroids.T)).argmin(1)


def fitted(sample: np.ndarray, clusters: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids of k-means on a sample: ``clusters`` at most, begun at different vectors of it."""
    distinct = np.unique(sample, axis=0)
    if not len(distinct):
        return distinct
    centroids = distinct[np.random.default_rng(seed).permutation(len(distinct))[:clusters]]
    for _ in range(rounds):
        own = np.concatenate([_nearest_centroid(sample[a : a + 4096], centroids) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=len(centroids))
        centroids = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def build(spark: SparkSession, vectors: DataFrame, place: tuple[str, ...], path: str, clusters: int | None = None) -> Clustered:
    """Write the index of ``vectors`` (the columns of ``place``, long, and ``embedding``) below ``path``, and load it.

    Without ``clusters``, there are as many as the square root of the vectors, up to MOST_CLUSTERS.
    """
    ship(spark)
    rows = vectors.select(*place, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    n = rows.count()
    first = rows.select(F.size("embedding").alias("width")).first()
    width = first["width"] if first else 0
    most = min(SAMPLE, max(1, SAMPLE_NUMBERS // max(1, width)))
    drawn = F.xxhash64(*place)
    sample, _ = _gathered(rows.where(F.pmod(drawn, F.lit(max(1, n // most))) == 0).orderBy(drawn).limit(most).select("embedding"), width)
    clusters = min(clusters or max(1, math.isqrt(n)), MOST_CLUSTERS)
    centroids = fitted(sample, clusters)
    del sample
    held = spark.sparkContext.broadcast(centroids)
    names = list(place)

    def assign(batches):
        centroids = held.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = _nearest_centroid(x, centroids)
                away = np.sqrt(((x - centroids[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(away)], [*names, "embedding", "cluster", "away"])

    kinds = ", ".join(f"{c} long" for c in names)
    assigned = rows.mapInArrow(assign, f"{kinds}, embedding array<double>, cluster int, away double")
    # Written before it is sorted by range, which reads it twice; the number spreads rows that are equal.
    assigned = materialize(spark, assigned.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "assigned")
    order = ["cluster", "away", *names, "tie"]
    out = assigned.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    out.write.mode("overwrite").option("compression", "zstd").partitionBy("cluster").parquet(f"{path}/vectors")
    sizes = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.min("away").alias("least"), F.max("away").alias("most"), F.count("*").alias("vectors")).collect()}
    told = [(c, [float(x) for x in centroids[c]], r["least"], r["most"], r["vectors"]) for c, r in sorted(sizes.items())]
    # A row for each cluster; written last, as the index counts once this is there.
    spark.createDataFrame(told, CLUSTER).coalesce(1).write.mode("overwrite").parquet(f"{path}/clusters")
    return load(spark, path, place)


def load(spark: SparkSession, path: str, place: tuple[str, ...]) -> Clustered:
    rows = spark.read.schema(CLUSTER).parquet(f"{path}/clusters").orderBy("cluster").collect()
    kinds = ", ".join(f"{c} long" for c in place)
    vectors = spark.read.schema(f"{kinds}, embedding array<double>, away double, cluster int").parquet(f"{path}/vectors")
    column = {c: np.array([r[c] for r in rows]) for c in ("cluster", "least", "most", "vectors")}
    return Clustered(vectors, place, column["cluster"], _matrix([r["centroid"] for r in rows]), column["least"], column["most"], column["vectors"])


def _homes(far: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """For each question (row), whether a cluster is one of its nearest that together hold k vectors."""
    order = far.argsort(axis=1, kind="stable")
    before = np.cumsum(counts[order], axis=1) - counts[order]
    homes = np.zeros(far.shape, bool)
    np.put_along_axis(homes, order, before < k, axis=1)
    return homes


def _candidates(held, index: Clustered, needed: np.ndarray, k: int) -> DataFrame:
    """query_id, score, place: of each piece of a batch that lies in one cluster, the k best for each question that meets it."""
    place = index.place

    def run(batches):
        ids, matrix, homes, centroids, bound, slack, max_score = held.value
        norms = (matrix**2).sum(1)
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(cluster)) + 1, len(cluster)] if len(cluster) else np.zeros(1, np.int64)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                piece = batch.slice(lo, hi - lo)
                c = int(cluster[lo])
                if homes is not None:
                    meets = np.flatnonzero(homes[c]) if c in homes else np.empty(0, np.int64)
                else:
                    far = np.sqrt(np.maximum(((matrix - centroids[c]) ** 2).sum(1), 0))
                    ring = piece.column(1).to_numpy()
                    meets = np.flatnonzero((far - bound <= ring.max() + slack) & (far + bound >= ring.min() - slack))
                if not len(meets):
                    continue
                # Places in order, so that a stable sort by score breaks ties by place.
                by = np.lexsort([piece.column(2 + j).to_numpy() for j in reversed(range(len(place)))])
                x = piece.column(2 + len(place)).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)[by]
                score = np.round(norms[meets, None] + (x**2).sum(1)[None, :] - 2 * (matrix[meets] @ x.T), DIGITS)
                at = np.argsort(score, axis=1, kind="stable")[:, :k]
                q = np.repeat(np.arange(len(meets)), at.shape[1])
                at = at.ravel()
                best = score[q, at]
                if max_score is not None:
                    kept = best <= max_score
                    q, at, best = q[kept], at[kept], best[kept]
                out = {"query_id": ids[meets[q]], "score": np.maximum(best, 0.0)}
                yield pa.RecordBatch.from_pydict(out | {n: piece.column(2 + j).to_numpy()[by[at]] for j, n in enumerate(place)})

    read = index.vectors if needed.all() else index.vectors.where(F.col("cluster").isin([int(c) for c in index.clusters[needed]]))
    schema = f"query_id long, score double, {', '.join(f'{c} long' for c in place)}"
    return read.select("cluster", "away", *place, "embedding").mapInArrow(run, schema)


def _ranked(near: DataFrame, place: tuple[str, ...], k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", *place)
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _block(questions: DataFrame, index: Clustered, k: int, max_score: float | None) -> tuple[DataFrame, list[tuple]]:
    spark = index.vectors.sparkSession
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    matrix, rows = _gathered(asked.where("embedding is not null"), index.centroids.shape[1])
    ids = rows.column("query_id").to_numpy()
    if not len(ids) or not len(index.clusters):
        return spark.createDataFrame([], f"query_id long, score double, {', '.join(f'{c} long' for c in index.place)}"), []
    far = np.sqrt(np.maximum((matrix**2).sum(1)[:, None] + (index.centroids**2).sum(1)[None, :] - 2 * matrix @ index.centroids.T, 0))
    slack = SLACK * max(1.0, float(np.sqrt((matrix**2).sum(1)).max()), float(np.sqrt((index.centroids**2).sum(1)).max()))
    homes = _homes(far, index.counts, k)
    centroids = dict(zip(index.clusters.tolist(), index.centroids, strict=True))
    by_cluster = {int(c): homes[:, j] for j, c in enumerate(index.clusters) if homes[:, j].any()}
    near_home = spark.sparkContext.broadcast((ids, matrix, by_cluster, None, None, slack, None))
    found = _ranked(_candidates(near_home, index, homes.any(0), k), index.place, k)
    worst = {r["query_id"]: r["score"] for r in found.where(F.col("rank") == k).select("query_id", "score").collect()}
    near_home.destroy()
    limit = math.inf if max_score is None else max_score
    bound = np.sqrt(np.maximum(np.array([min(worst.get(q, math.inf), limit) for q in ids.tolist()]), 0) + 10.0**-DIGITS)
    needs = (far - bound[:, None] <= index.most[None, :] + slack) & (far + bound[:, None] >= index.least[None, :] - slack)
    reach = [(q, int(n), int(v)) for q, n, v in zip(ids.tolist(), needs.sum(1), needs @ index.counts, strict=True)]
    last = spark.sparkContext.broadcast((ids, matrix, None, centroids, bound, slack, max_score))
    return _candidates(last, index, needs.any(0), k), reach


def search(questions: DataFrame, index: Clustered, k: int, max_score: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, rank, score, place), as ``retrieval.nearest`` gives them; and each question's reach.

    Reach: query_id, clusters and vectors that the question's bound could not rule out, of all that there are. Batches
    within these clusters that lie in rings out of reach are left out as well, so the question met fewer yet. Questions' ids differ.
    """
    spark = index.vectors.sparkSession
    ship(spark)
    n = questions.count()
    parts = 1 if n <= BLOCK else -(-n // (BLOCK // 2))
    near, told = None, []
    for b in range(parts):
        own = questions if parts == 1 else questions.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b)
        one, reach = _block(own, index, k, max_score)
        if parts > 1:  # one block's matrix is held at a time, and a block's reach is written with it
            one = materialize(spark, one, "candidates")
        near = one if near is None else near.unionByName(one)
        reach = spark.createDataFrame(reach, "query_id long, clusters long, vectors long")
        told.append(materialize(spark, reach, "reach") if parts > 1 else reach)
    reach = told[0]
    for more in told[1:]:
        reach = reach.unionByName(more)
    return _ranked(near, index.place, k), reach


def retrieve(
    questions: DataFrame, index: Clustered, chunks: DataFrame, k: int = SETTINGS.top_k, threshold: float = SETTINGS.retrieval_threshold
) -> DataFrame:
    """Hits that pass the gate, as ``retrieval.retrieve`` with ``only_passing`` gives them: query_id, rank, page_no, chunk_no, score, and the
    chunk's columns. ``questions``: query_id, question, embedding; blank ones have no hits. ``index``: of the vectors of ``chunks``."""
    asked = questions.where(T.strip(F.coalesce(F.col("question"), F.lit(""))) != "")
    near, _ = search(asked, index, k, threshold)
    texts = chunks.drop("embedding", "start_word")
    few = asked.count() * k <= retrieval.BROADCAST_ROWS
    hits = (F.broadcast(near) if few else near).join(texts, list(PLACE))
    return hits.select("query_id", "rank", F.round("score", 6).alias("score"), retrieval.passes(F.col("score"), threshold).alias("passes_threshold"), *texts.columns)
