"""Retrieval evaluation: hits of the expected chapter, gate results, rates, and a comparison of window sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import SETTINGS
from quern.functions import text as T

#: id, label, window size, overlap (fixed values).
STRATEGIES = (
    ("A", "500-word chunks, 100-word overlap (production)", 500, 100),
    ("B", "300-word chunks, 50-word overlap", 300, 50),
)


def _same(column: Column) -> Column:
    return T.strip(T.nfc(F.coalesce(column, F.lit(""))))


def eval_rows(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, type, expected_chapter, retrieved_chapters, scores, best_score, passes_threshold, hit: a row a question.

    ``questions``: query_id, type, expected_chapter. A question without hits doesn't pass; hit is null unless it is
    answerable; a missing expected chapter counts as an empty one.
    """
    # At most k hits a question, so these lists are short.
    chapter = F.coalesce(F.col("chapter"), F.lit(""))
    seen = hits.withColumn("chapter_", _same(F.col("chapter"))).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", chapter.alias("chapter"), "score", "passes_threshold", "chapter_"))).alias("hits_")
    )
    kind = F.lower(T.strip(F.coalesce(F.col("type"), F.lit(""))))
    rows = questions.select("query_id", kind.alias("type"), "expected_chapter", _same(F.col("expected_chapter")).alias("wanted_")).join(seen, "query_id", "left")
    best = F.get("hits_", F.lit(0))
    none = F.array()
    found = F.coalesce(F.exists("hits_", lambda h: h["chapter_"] == F.col("wanted_")), F.lit(False))
    return rows.select(
        "query_id",
        "type",
        "expected_chapter",
        F.coalesce(F.transform("hits_", lambda h: h["chapter"]), none.cast("array<string>")).alias("retrieved_chapters"),
        F.coalesce(F.transform("hits_", lambda h: h["score"]), none.cast("array<double>")).alias("scores"),
        best["score"].alias("best_score"),
        F.coalesce(best["passes_threshold"], F.lit(False)).alias("passes_threshold"),
        F.when(F.col("type") == "answerable", found).alias("hit"),
    )


def _counts() -> list[Column]:
    answerable, unanswerable = F.col("type") == "answerable", F.col("type") == "unanswerable"
    return [
        F.count_if(answerable).alias("answerable"),
        F.count_if(F.coalesce(F.col("hit"), F.lit(False))).alias("hits"),
        F.count_if(answerable & F.col("passes_threshold")).alias("threshold_passes"),
        F.count_if(unanswerable).alias("unanswerable"),
        F.count_if(unanswerable & ~F.col("passes_threshold")).alias("unanswerable_gated"),
    ]


def eval_summary(rows: DataFrame, k: int = SETTINGS.top_k, threshold: float = SETTINGS.retrieval_threshold) -> DataFrame:
    """One row of counts and rates over answerable questions; rates are null without any."""
    return rows.agg(*_counts()).select(
        F.lit(k).cast("long").alias("k"),
        F.lit(float(threshold)).alias("threshold"),
        "answerable",
        "hits",
        F.try_divide("hits", "answerable").alias("hit_rate"),
        "threshold_passes",
        F.try_divide("threshold_passes", "answerable").alias("threshold_pass_rate"),
        "unanswerable",
        "unanswerable_gated",
    )


def compare(parts: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """A row a strategy, best first: hit rate falling with null last, then id. ``parts``: id to (evaluation rows, chunks)."""
    out = None
    for name, label, size, overlap in STRATEGIES:
        rows, chunks = parts[name]
        one = rows.agg(*_counts()).join(F.broadcast(chunks.agg(F.count("*").alias("n_chunks"))))
        one = one.select(
            F.lit(name).alias("id"), F.lit(label).alias("label"), F.lit(size).cast("long").alias("chunk_size"), F.lit(overlap).cast("long").alias("overlap"),
            "n_chunks", "hits", "answerable", F.try_divide("hits", "answerable").alias("hit_rate"),
        )
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc_nulls_last("hit_rate"), "id")


def _fixed(number: Column, digits: int) -> Column:
    """A number from 0 on with so many decimals, as printf writes it: the double's own value is rounded, not its shortest decimal half up."""
    least = F.lit(float(f"1e-{digits}"))
    # Below the last decimal, the pattern would write a half as nothing.
    number = F.when((number >= float(f"5e-{digits + 1}")) & (number < least), least).otherwise(number)
    return F.call_function("format_number", number, F.lit("0." + "0" * digits))


def report(rows: DataFrame) -> DataFrame:
    """query_id and a line of text for each question."""
    best = F.coalesce(_fixed(F.col("best_score"), 4), F.lit("n/a"))
    mark = F.when(F.col("type") != "answerable", "-").when(F.col("hit"), "HIT").otherwise("MISS")
    gate = F.when(F.col("passes_threshold"), "PASS").otherwise("FAIL")
    return rows.select("query_id", F.concat(F.lit("["), "type", F.lit("] best "), best, F.lit(" gate "), gate, F.lit(" chapter "), mark).alias("line"))


def percent(rate: Column) -> Column:
    return F.coalesce(F.concat(_fixed(rate * 100, 2), F.lit("%")), F.lit("n/a"))


def _of(part: Column, whole: Column) -> Column:
    return F.concat(part.cast("string"), F.lit("/"), whole.cast("string"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """line_no and a line of text for each part of a summary."""
    c = F.col
    lines = [
        F.concat(F.lit("hit rate: "), _of(c("hits"), c("answerable")), F.lit(" = "), percent(c("hit_rate"))),
        F.concat(F.lit("threshold passes: "), _of(c("threshold_passes"), c("answerable")), F.lit(" = "), percent(c("threshold_pass_rate"))),
        F.concat(F.lit("unanswerable gated: "), _of(c("unanswerable_gated"), c("unanswerable"))),
    ]
    return summary.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def comparison_line() -> Column:
    c = F.col
    return F.concat(c("id"), F.lit(" "), c("label"), F.lit(": "), c("n_chunks").cast("string"), F.lit(" chunks, "), _of(c("hits"), c("answerable")), F.lit(" = "), percent(c("hit_rate")))
