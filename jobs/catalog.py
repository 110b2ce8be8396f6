"""The jobs as registered queries: each runs twice into a new folder, and gives the whole output after that; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import judge_retrieval, keep_index
from quern.plans import fixtures as X
from quern.shared import fresh_path


def job1_keep_index(spark: SparkSession, folder: str) -> DataFrame:
    base = fresh_path(spark, "keep-index")
    for _ in range(2):
        keep_index.keep_index(spark, f"{folder}/documents.parquet", f"{base}/out", f"{base}/checkpoint")
    used = F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("used")
    return keep_index.current(spark, f"{base}/out").select("page_no", "chunk_no", "chunk_id", "book", "chapter", "section", "source_url", "text", used)


def job2_judge_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_path(spark, "judge-retrieval")
    for _ in range(2):
        run = judge_retrieval.judge_retrieval(spark, f"{folder}/benchmark.parquet", f"{folder}/documents.parquet", out)
    rows, summary, thresholds = (judge_retrieval.read(spark, out, t, run).drop("run") for t in judge_retrieval.TABLES)
    rows = rows.withColumn("retrieved_chapters", F.array_join("retrieved_chapters", ","))
    rates = {c: F.round(c, 9) for c in ("hit_rate", "threshold_pass_rate")}
    named = [df.withColumn("part", F.lit(t)) for t, df in zip(judge_retrieval.TABLES, (rows, summary.withColumns(rates), thresholds), strict=True)]
    return named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)


QUERIES = {"job1_keep_index": job1_keep_index, "job2_judge_retrieval": job2_judge_retrieval}


def _judged(name: str, size: int, overlap: int) -> tuple[str, str]:
    """CTEs of a strategy and the selects of its three tables."""
    c, h, r = f"chunks_{name}", f"hits_{name}", f"rows_{name}"
    ctes = f"""{X.chunk_ctes(size, overlap, name=c)}, {X.hit_ctes(c, h)},
        {r} AS (SELECT *, CASE WHEN type = 'answerable' THEN list_contains(chapters, expected_chapter) END AS hit FROM (
            SELECT g.query_id, g.type, g.expected_chapter, coalesce(list(h.chapter ORDER BY h.rank) FILTER (h.rank IS NOT NULL), []) AS chapters, min(h.score) AS best_score,
            coalesce(bool_or(h.passes_threshold AND h.rank = 1), false) AS passes_threshold FROM gold_ g LEFT JOIN {h} h USING (query_id) GROUP BY ALL)),
        t_{name} AS (SELECT t AS threshold, count_if(type = 'answerable') AS answerable, count_if(type = 'answerable' AND coalesce(best_score <= t, false)) AS threshold_passes,
            count_if(type = 'unanswerable') AS unanswerable, count_if(type = 'unanswerable' AND NOT coalesce(best_score <= t, false)) AS unanswerable_gated
            FROM {r}, (SELECT unnest([0.4, 0.6, 0.8, 1.0, 1.2]::DOUBLE[]) AS t) GROUP BY t),
        m_{name} AS (SELECT *, round((coalesce(threshold_passes / nullif(answerable, 0), 0) + coalesce(unanswerable_gated / nullif(unanswerable, 0), 0)) / 2, 9) AS mean_rate FROM t_{name})"""
    selects = f"""SELECT 'rows' AS part, '{name}' AS strategy, query_id, type, expected_chapter, array_to_string(chapters, ',') AS retrieved_chapters, best_score, passes_threshold, hit FROM {r}
        UNION ALL BY NAME SELECT 'summary' AS part, '{name}' AS strategy, 5::BIGINT AS k, 1.0::DOUBLE AS threshold, count_if(type = 'answerable')::BIGINT AS answerable,
            count_if(coalesce(hit, false))::BIGINT AS hits, round(count_if(coalesce(hit, false)) / nullif(count_if(type = 'answerable'), 0), 9) AS hit_rate,
            count_if(type = 'answerable' AND passes_threshold)::BIGINT AS threshold_passes,
            round(count_if(type = 'answerable' AND passes_threshold) / nullif(count_if(type = 'answerable'), 0), 9) AS threshold_pass_rate,
            count_if(type = 'unanswerable')::BIGINT AS unanswerable, count_if(type = 'unanswerable' AND NOT passes_threshold)::BIGINT AS unanswerable_gated,
            (SELECT count(*) FROM {c})::BIGINT AS n_chunks, {size}::INTEGER AS chunk_size, {overlap}::INTEGER AS overlap FROM {r}
        UNION ALL BY NAME SELECT 'thresholds' AS part, '{name}' AS strategy, threshold, answerable::BIGINT AS answerable, threshold_passes::BIGINT AS threshold_passes,
            unanswerable::BIGINT AS unanswerable, unanswerable_gated::BIGINT AS unanswerable_gated, mean_rate,
            threshold = (SELECT arg_max(threshold, (mean_rate, -threshold)) FROM m_{name}) AS best FROM m_{name}"""
    return ctes, selects


_parts = [_judged(*s) for s in (("A", 500, 100), ("B", 300, 50))]

SQL = {
    "job1_keep_index": f"""WITH {X.PAGES}, {X.chunk_ctes()}
        SELECT page_no, chunk_no, chunk_id, book, chapter, section, source_url, text,
               len(list_distinct(list_transform({X.words("text")}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 256)))::BIGINT AS used FROM chunks_""",
    "job2_judge_retrieval": f"WITH {X.PAGES}, {X.GOLD}, {', '.join(p[0] for p in _parts)} {' UNION ALL BY NAME '.join(p[1] for p in _parts)}",
}
