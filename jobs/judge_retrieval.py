"""Judge how well questions find their pages: hit rates by window size, and which distance makes the best gate.

    python -m jobs.judge_retrieval QUESTIONS PAGES OUT [--config FILE]

QUESTIONS and PAGES are Parquet tables. The pages are cleaned and their words hashed once. For each strategy (window size and overlap) of
the config, they are cut, embedded and written as an index, every question is asked against all of it, and OUT gets, partitioned by run and strategy:

- ``rows``: each question's expected chapter, the chapters found, its best score, and whether it was a hit and passed the gate;
- ``summary``: hits and gate results with their rates;
- ``thresholds``: for each candidate distance, how many answerable questions it lets pass and how many unanswerable ones it stops,
  the mean of both rates, and whether it is the best (the greatest mean, then the least distance).

A question without a given type is answerable if a page holds its text, and its chapter is the first such page's.

Rerun: a run's name holds a digest of its config, so a run writes over its own partitions and no other's, and the same tables give the
same result. The index lies below OUT too, by the same name. Prepared pages lie in the application's part of the shared folder: a run of
another application, or over other files, prepares its own.
"""

from __future__ import annotations

import argparse
import hashlib
import logging
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import shipped
from quern import __version__
from quern.operators import chunking, embedding, evaluation, retrieval
from quern.plans.fixtures import first_occurrences
from quern.shared import materialize, spread, written_once
from quern.sources import index

log = logging.getLogger("jobs.judge_retrieval")
CONFIG = Path(__file__).with_suffix(".toml")
TABLES = ("rows", "summary", "thresholds")


@dataclass(frozen=True)
class Config:
    """``pages`` and ``questions`` say how each column is made of the input's, in SQL."""

    name: str = "run"
    top_k: int = 5
    threshold: float = 0.4
    thresholds: list[float] = field(default_factory=list)
    strategies: list[dict] = field(default_factory=list)
    pages: dict[str, str] = field(default_factory=dict)
    questions: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path = CONFIG) -> Config:
        config = cls(**tomllib.loads(Path(path).read_text(encoding="utf-8")))
        if not config.strategies or len({s["id"] for s in config.strategies}) < len(config.strategies):
            raise ValueError("strategies need ids, each its own")
        if not all(str(s["id"])[:1].isalpha() for s in config.strategies):
            raise ValueError("a strategy's id begins with a letter, as it names a folder")
        for s in config.strategies:
            chunking.validate(s["chunk_size"], s["overlap"])
        if {"query_id", "question"} - set(config.questions) or ("type" in config.questions) != ("expected_chapter" in config.questions):
            raise ValueError("questions need query_id and question, and type and expected_chapter together")
        return config

    @property
    def run(self) -> str:
        return f"{self.name}-{hashlib.sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()[:12]}"


def _mapped(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.select(*[F.expr(e).alias(c) for c, e in columns.items()])


def with_gold(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """query_id, question, type and expected_chapter: the chapter of the first page that holds the question's text."""
    items = asked.select(F.col("query_id").alias("item_id"), F.col("question").alias("text"))
    found = first_occurrences(pages.select(F.col("page_no").alias("doc_id"), "text"), items).withColumnRenamed("doc_id", "page_no")
    found = found.join(pages.select("page_no", "chapter"), "page_no").groupBy("item_id").agg(F.min("chapter").alias("expected_chapter"))
    rows = asked.join(found, asked["query_id"] == found["item_id"], "left").drop("item_id")
    return rows.withColumn("type", F.when(F.col("expected_chapter").isNull(), "unanswerable").otherwise("answerable"))


def swept(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """What each distance as a gate would let pass and stop; summed up before it is shuffled, one row a distance."""
    at = rows.select("type", "best_score", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    passing = F.coalesce(F.col("best_score") <= F.col("threshold"), F.lit(False))
    sums = at.groupBy("threshold").agg(
        F.count_if(F.col("type") == "answerable").alias("answerable"),
        F.count_if((F.col("type") == "answerable") & passing).alias("threshold_passes"),
        F.count_if(F.col("type") == "unanswerable").alias("unanswerable"),
        F.count_if((F.col("type") == "unanswerable") & ~passing).alias("unanswerable_gated"),
    )
    passed, gated = F.try_divide("threshold_passes", "answerable"), F.try_divide("unanswerable_gated", "unanswerable")
    rates = sums.withColumn("mean_rate", F.round((F.coalesce(passed, F.lit(0.0)) + F.coalesce(gated, F.lit(0.0))) / 2, 9))
    best = rates.agg(F.max_by("threshold", F.struct("mean_rate", -F.col("threshold"))).alias("best_threshold"))
    return rates.join(F.broadcast(best)).withColumn("best", F.col("threshold") == F.col("best_threshold")).drop("best_threshold")


#: Numbers of vectors and texts are written as they are: looking each up in a dictionary takes longer, and files get no smaller by it.
PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("embedding.list.element", "text")}


def _put(rows: DataFrame, path: str, run: str, strategy: str, **options: str) -> None:
    told = rows.withColumns({"run": F.lit(run), "strategy": F.lit(strategy)})
    told.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd", **options).partitionBy("run", "strategy").parquet(path)


def read(spark: SparkSession, out: str, table: str, run: str) -> DataFrame:
    """One of TABLES of a run."""
    return spark.read.parquet(f"{out}/{table}").where(F.col("run") == run)


def judge_retrieval(spark: SparkSession, questions: str, pages: str, out: str, config: Config | None = None) -> str:
    """Judge all strategies of the config, and give the run's name."""
    config = config or Config.load()
    with shipped(spark):
        _judge(spark, questions, pages, out, config)
    log.info("wrote run %s below %s", config.run, out)
    return config.run


def _judge(spark: SparkSession, questions: str, pages: str, out: str, config: Config) -> None:
    asked = _mapped(spark.read.parquet(questions), config.questions)
    source = spark.read.parquet(pages)
    texts = _mapped(spread(source), config.pages)
    gold = asked if "type" in config.questions else with_gold(asked, texts)
    gold = materialize(spark, gold.select("query_id", "question", "type", "expected_chapter"), "gold")
    log.info("read %d questions of %s and %d pages of %s", gold.count(), questions, source.count(), pages)
    vectors = materialize(spark, gold.select("query_id", "question").withColumn("embedding", embedding.questions(F.col("question"))), "asked")
    # Once for windows of all sizes, and for all runs of an application over the same files.
    key = ("prepared", sorted(config.pages.items()), __version__)
    prepared = written_once(spark, "prepared", source, key, lambda: chunking.prepared(texts))
    for s in config.strategies:
        _put(index.windows(prepared, s["chunk_size"], s["overlap"]), f"{out}/index", config.run, s["id"], **PLAIN)
        held = read(spark, out, "index", config.run).where(F.col("strategy") == s["id"]).drop("run", "strategy")
        hits = retrieval.retrieve(vectors, held, config.top_k, config.threshold)
        _put(evaluation.eval_rows(gold, hits).drop("scores"), f"{out}/rows", config.run, s["id"])
        rows = read(spark, out, "rows", config.run).where(F.col("strategy") == s["id"])
        summary = evaluation.eval_summary(rows, config.top_k, config.threshold)
        size = held.agg(F.count("*").alias("n_chunks"))
        _put(summary.join(F.broadcast(size)).withColumns({"chunk_size": F.lit(s["chunk_size"]), "overlap": F.lit(s["overlap"])}), f"{out}/summary", config.run, s["id"])
        _put(swept(rows, config.thresholds or [config.threshold]), f"{out}/thresholds", config.run, s["id"])
        lines = evaluation.summary_lines(read(spark, out, "summary", config.run).where(F.col("strategy") == s["id"])).orderBy("line_no")
        log.info("strategy %s: wrote %d chunks and %d rows; %s", s["id"], held.count(), rows.count(), "; ".join(r["line"] for r in lines.collect()))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.judge_retrieval", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("questions", "pages", "out"):
        parser.add_argument(name)
    parser.add_argument("--config", default=CONFIG)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("judge-retrieval").getOrCreate()
    try:
        judge_retrieval(spark, given.questions, given.pages, given.out, Config.load(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
