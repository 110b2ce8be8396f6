"""Commands: crawl a collection, build its index, ask it, evaluate retrieval. Places left out are those of the settings.

    python -m quern.cli crawl [PAGES] [--url URL] [--landed FOLDER]   page records of a collection, as Parquet
    python -m quern.cli build [PAGES] [INDEX]          the vector index of page records (Parquet, or a JSON array)
    python -m quern.cli ask INDEX QUESTION...          answers with their sources
    python -m quern.cli evaluate QUESTIONS [INDEX] [--compare PAGES]
    python -m quern.cli ready [INDEX]                  what stands in the way of a question
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import SETTINGS
from quern.operators import chunking, embedding, evaluation, retrieval
from quern.shipping import ship
from quern.sources import crawl, index, readiness, tables
from quern.streaming import answers


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records with page_no, from Parquet or from a JSON array in its order."""
    if path.endswith(".json"):
        return tables.read_pages(spark, path).withColumn("page_no", F.col("position") + 1)
    return spark.read.parquet(path)


def _questions(spark: SparkSession, path: str) -> DataFrame:
    rows = tables.read_questions(spark, path).withColumnRenamed("position", "query_id")
    return rows.withColumn("embedding", embedding.questions(F.col("question")))


def evaluate(spark: SparkSession, path: str, where: str, pages: str | None = None) -> list[str]:
    questions = _questions(spark, path)
    if pages:
        parts = {}
        for name, _, size, overlap in evaluation.STRATEGIES:
            own = index.vectors(chunking.nonempty(chunking.chunk_pages(read_pages(spark, pages), size, overlap)))
            parts[name] = (evaluation.eval_rows(questions, retrieval.retrieve(questions, own)), own)
        lines = evaluation.compare(parts).select(evaluation.comparison_line().alias("line"))
        return [r["line"] for r in lines.collect()]
    rows = evaluation.eval_rows(questions, retrieval.retrieve(questions, index.load(spark, where)))
    lines = [r["line"] for r in evaluation.report(rows).orderBy("query_id").collect()]
    return lines + [r["line"] for r in evaluation.summary_lines(evaluation.eval_summary(rows)).collect()]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, places in (("crawl", ["pages"]), ("build", ["pages", "index"]), ("ask", ["index"]), ("evaluate", ["questions", "index"]), ("ready", ["index"])):
        one = sub.add_parser(name)
        for place in places:
            free = name != "ask" and place in ("pages", "index")
            one.add_argument(place, **({"nargs": "?", "default": SETTINGS.place(place)} if free else {}))
    sub.choices["crawl"].add_argument("--url", default=SETTINGS.book_url)
    sub.choices["crawl"].add_argument("--landed", help="keep fetched pages here, and fetch only what it lacks")
    sub.choices["ask"].add_argument("question", nargs="+")
    sub.choices["evaluate"].add_argument("--compare")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    ship(spark)
    if given.command == "crawl":
        records, outcomes = crawl.crawl(spark, given.url, where=given.landed)
        records.write.mode("overwrite").parquet(given.pages)
        for r in outcomes.orderBy("outcome").collect():
            print(f"{r['outcome']}: {r['pages']}")
    elif given.command == "build":
        made = index.build(chunking.chunk_pages(read_pages(spark, given.pages)), given.index)
        print(f"chunks: {made.count()}")
    elif given.command == "ask":
        asked = spark.createDataFrame(list(enumerate(given.question)), "query_id long, question string")
        for r in answers.answer(asked, index.load(spark, given.index)).orderBy("query_id").collect():
            print(r["answer"], *(f"  {s['chapter']} {s['section']} {s['source_url']}" for s in r["sources"]), sep="\n")
    elif given.command == "ready":
        print(*([readiness.ADVICE[e] for e in readiness.errors(spark, given.index)] or ["ready"]), sep="\n")
    else:
        print(*evaluate(spark, given.questions, given.index, given.compare), sep="\n")


if __name__ == "__main__":
    main()
