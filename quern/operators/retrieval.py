"""Exact nearest neighbours for batches of questions, with a distance gate.

Scores are squared distances of unit vectors: lower is better, and a score passes at the threshold or under it.
The index is read once for each block of questions: tiles of vectors are multiplied with the block's matrix, and a
task keeps its best k a question, by score and then by place, so what is shuffled are k rows a task and question.
A block holds BLOCK questions at most, which bounds what is broadcast; more questions are more blocks. A tile has CELLS
scores about, so what a task holds grows with neither questions nor vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import SETTINGS
from quern.functions import text as T
from quern.shared import materialize
from quern.shipping import ship

BLOCK = 4096
#: Scores that a task holds at once, about: a batch of vectors meets the block tile by tile.
CELLS = 1 << 20
#: Stands for the place of a hit that is not found yet.
NOWHERE = np.iinfo(np.int64).max
#: Hits that are broadcast to the index's texts at most; with more, the join shuffles both sides.
BROADCAST_ROWS = 1 << 20
DIGITS = 9
METRIC, HIGHER_IS_BETTER = "l2_distance", False


def cosine_from_score(score: Column) -> Column:
    """1 - score**2 / 2, held between -1 and 1: for showing, never for the gate."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.pow(score, F.lit(2.0)) / 2))


def passes(score: Column, threshold: float = SETTINGS.retrieval_threshold) -> Column:
    return score.cast("double") <= F.lit(float(threshold))


def nearest(questions: DataFrame, index: DataFrame, k: int, place: tuple[str, ...], max_score: float | None = None) -> DataFrame:
    """query_id, rank, score and the place of the k nearest vectors of each question.

    ``questions``: query_id, embedding. ``index``: the columns of ``place`` (long), embedding. With ``max_score``, only
    what passes counts; scores rise with rank, so that may be asked before ranking.
    """
    spark = index.sparkSession
    ship(spark)
    n = questions.count()
    blocks = [questions] if n <= BLOCK else [questions.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // (BLOCK // 2)))) == b) for b in range(-(-n // (BLOCK // 2)))]
    schema = f"query_id long, score double, {', '.join(f'{c} long' for c in place)}"
    near = None
    for block in blocks:
        run, held = _search(block, k, place, max_score)
        part = index.select(*place, "embedding").mapInArrow(run, schema)
        if len(blocks) > 1:  # candidates are written block by block, so that one block's matrix is held at a time
            part = materialize(spark, part, "candidates")
            held.destroy()
        near = part if near is None else near.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("score", *place)
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _search(block: DataFrame, k: int, place: tuple[str, ...], max_score: float | None):
    rows = block.select("query_id", "embedding").toPandas()
    ids = rows["query_id"].to_numpy(np.int64)
    matrix = np.array(rows["embedding"].tolist(), dtype=np.float64).reshape(len(ids), -1 if len(ids) else 0)
    held = block.sparkSession.sparkContext.broadcast((ids, matrix, (matrix**2).sum(1)))

    def run(batches):
        ids, matrix, norms = held.value
        # The k best of each question so far, of the whole task. NaN is worse than any score, so it fills what is not found yet.
        best = np.full((len(ids), k), np.nan)
        at = [np.full((len(ids), k), NOWHERE) for _ in place]
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            flat = batch.column(len(place)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            vectors = flat.reshape(batch.num_rows, -1)
            spots = [batch.column(c).to_numpy() for c in range(len(place))]
            # Places in order, so that a stable sort by score breaks ties by place.
            by = np.lexsort(spots[::-1])
            step = max(1, CELLS // len(ids))
            for a in range(0, batch.num_rows, step):
                own = by[a : a + step]
                tile = vectors[own]
                score = norms[:, None] + (tile**2).sum(1)[None, :]
                dots = matrix @ tile.T
                dots *= 2
                score -= dots
                np.maximum(np.round(score, DIGITS, out=score), 0.0, out=score)
                bound = best[:, -1] if max_score is None else np.fmin(best[:, -1], max_score)
                met = np.flatnonzero(~(score > bound[:, None]).all(1))
                for m in (met[c : c + len(ids) // 8 + 1] for c in range(0, len(met), len(ids) // 8 + 1)):
                    near = np.argsort(score[m], axis=1, kind="stable")[:, :k]
                    scores = np.hstack([best[m], np.take_along_axis(score[m], near, 1)])
                    places = [np.hstack([x[m], y[own][near]]) for x, y in zip(at, spots, strict=True)]
                    first = np.lexsort((*places[::-1], scores), axis=-1)[:, :k]
                    best[m] = np.take_along_axis(scores, first, 1)
                    for x, y in zip(at, places, strict=True):
                        x[m] = np.take_along_axis(y, first, 1)
        kept = at[0] != NOWHERE
        if max_score is not None:
            kept &= best <= max_score
        out = {"query_id": np.repeat(ids, k)[kept.ravel()], "score": best[kept]}
        yield pa.RecordBatch.from_pydict(out | {c: x[kept] for c, x in zip(place, at, strict=True)})

    return run, held


PLACE = ("page_no", "chunk_no")


def retrieve(
    questions: DataFrame,
    index: DataFrame,
    k: int = SETTINGS.top_k,
    threshold: float = SETTINGS.retrieval_threshold,
    only_passing: bool = False,
) -> DataFrame:
    """Hits: query_id, rank, score, cosine_similarity, cosine_true, passes_threshold, and the chunk's columns.

    ``questions``: query_id, question, embedding; blank questions have no hits. ``index``: chunks with embedding.
    """
    asked = questions.where(T.strip(F.coalesce(F.col("question"), F.lit(""))) != "")
    near = nearest(asked, index, k, PLACE, threshold if only_passing else None)
    chunks = index.drop("embedding", "start_word")
    # k rows of a few numbers a question: sent to all while they are few, so that no text is shuffled.
    few = asked.count() * k <= BROADCAST_ROWS
    hits = (F.broadcast(near) if few else near).join(chunks, list(PLACE))
    score = F.round("score", 6)
    return hits.select(
        "query_id",
        "rank",
        score.alias("score"),
        F.lit(METRIC).alias("score_metric"),
        F.lit(HIGHER_IS_BETTER).alias("higher_is_better"),
        F.round(cosine_from_score(F.col("score")), 6).alias("cosine_similarity"),
        F.round(1 - F.col("score") / 2, 6).alias("cosine_true"),
        passes(F.col("score"), threshold).alias("passes_threshold"),
        *[c for c in chunks.columns],
    )
