"""Questions from a stream, answered batch by batch against a fixed index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quern.config import SETTINGS
from quern.operators import answering, embedding, retrieval
from quern.shipping import ship


def answer(questions: DataFrame, index: DataFrame, k: int = SETTINGS.top_k, threshold: float = SETTINGS.retrieval_threshold, limit: int = SETTINGS.generation_k) -> DataFrame:
    """Answers to a batch of questions (query_id, question)."""
    ship(index.sparkSession)
    asked = questions.withColumn("embedding", embedding.questions(F.col("question")))
    return answering.answers(asked, retrieval.retrieve(asked, index, k, threshold), limit)


def answer_stream(questions: DataFrame, index: DataFrame, out: str, checkpoint: str, **settings) -> StreamingQuery:
    """Writes answers of each micro-batch to a folder of its own, so that a repeated batch replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows, index, **settings).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
