"""The corpus pipeline: quality rules, toxicity, near duplicates, secret scans and packing, one after another.

Each stage takes all rows of the one before, with any other columns. An empty table gives an empty table. Null and empty
texts have no words and fail the quality rules; the later stages, given some, keep them: they score like any text, link
with nothing, hold no secrets, and are packed as their end mark alone. Null and repeated ids are ids like any others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import jaccard, packing, rules, secrets, toxicity
from quern.llm.common import discard, materialize, table, tracked

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made: list[str] = []


def _stage(fn: Stage) -> Stage:
    """A stage's input was written, so what earlier stages of the same run wrote for themselves goes before it starts."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if fn is quality_rules:
            _made.clear()
        else:
            discard(spark, _made, docs)
        with tracked(_made):
            return fn(spark, docs, sf_dir)

    return run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    return rules.judge(spark, docs, table(spark, sf_dir, "labels"), whole=True).where("kept").select("row.*")


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half."""
    return toxicity.keep_clean(spark, docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, the one with the least id; what links with nothing stays, whatever its id."""
    return jaccard.deduplicate(spark, docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _stage(quality_rules)),
    ("toxicity", _stage(toxic_texts)),
    ("ngram_jaccard", _stage(near_duplicates)),
    ("secret_scans", _stage(secret_scans)),
    ("packing", _stage(packed)),
]

#: Tokenizers, trees and similarity joins are beyond SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(spark, docs, "stage")
    return docs
