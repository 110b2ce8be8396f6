"""Queries by name, and for each the SQL that another engine answers the same with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import NO_ANSWER
from quern.functions import html as H
from quern.functions import sql as S
from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import answering, chunking, citations, discovery, embedding, evaluation, lsh, ordering, pruning, retrieval
from quern.plans import fixtures as X
from quern.shared import fresh_path, materialize, spread
from quern.shipping import ship
from quern.sources.tables import table
from quern.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        QUERIES[name or fn.__name__] = run
        SQL[name or fn.__name__] = sql
        return fn

    return add


# --- text ---

_odd = X.lit(X.ODD)


@query(f"SELECT doc_id, nfc_normalize(text || {_odd}) AS nfc FROM documents")
def nfc_text(spark, folder):
    return spread(table(spark, folder, "documents")).select("doc_id", T.nfc(F.concat("text", F.lit(X.ODD))).alias("nfc"))


@query(f"SELECT doc_id, {X.clean(f'({_odd} || text || {_odd})')} AS clean FROM documents")
def clean_text(spark, folder):
    return spread(table(spark, folder, "documents")).select("doc_id", T.clean(F.concat(F.lit(X.ODD), "text", F.lit(X.ODD))).alias("clean"))


_headed = "(CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR || ' ' || chr(10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN source || chr(10) ELSE '' END || text)"


@query(
    f"""WITH a AS (SELECT doc_id, source, doc_id::VARCHAR AS h, {_headed} AS text FROM documents),
    b AS (SELECT * REPLACE ({X.heading('text', 'h')} AS text) FROM a)
    SELECT doc_id, {X.heading('text', 'source')} AS stripped FROM b"""
)
def strip_heading(spark, folder):
    chapter = F.col("doc_id").cast("string")
    headed = F.concat(
        F.when(F.col("doc_id") % 3 == 0, F.concat(chapter, F.lit(" \n"))).otherwise(""),
        F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("\n"))).otherwise(""),
        "text",
    )
    rows = spread(table(spark, folder, "documents")).select("doc_id", "source", headed.alias("text"))
    return rows.select("doc_id", T.strip_headings(F.col("text"), chapter, F.col("source")).alias("stripped"))


@query(f"SELECT doc_id, len({X.words(f'(text || {_odd})')})::INTEGER AS n_words, array_to_string({X.words(f'(text || {_odd})')}, '|') AS words FROM documents")
def tokenize_words(spark, folder):
    words = T.words(F.concat("text", F.lit(X.ODD)))
    return spread(table(spark, folder, "documents")).select("doc_id", F.size(words).alias("n_words"), F.array_join(words, "|").alias("words"))


_asked = "(CASE item_id % 3 WHEN 0 THEN ' query: ' WHEN 1 THEN 'passage:' ELSE chr(160) END || text)"


@query(
    f"""SELECT item_id, CASE WHEN starts_with({X.strip(_asked)}, 'query:') OR starts_with({X.strip(_asked)}, 'passage:')
    THEN {X.strip(_asked)} ELSE 'query: ' || {X.strip(_asked)} END AS prefixed FROM benchmark"""
)
def e5_prefix(spark, folder):
    kind = F.col("item_id") % 3
    text = F.concat(F.when(kind == 0, " query: ").when(kind == 1, "passage:").otherwise(" "), "text")
    return table(spark, folder, "benchmark").select("item_id", T.with_prefix(text, "query: ").alias("prefixed"))


# --- chunks ---


@query(f"SELECT doc_id, unnest({X.starts('n', 50, 20)})::INTEGER AS start_word FROM (SELECT doc_id, len({X.words('text')}) AS n FROM documents)")
def window_starts(spark, folder):
    n = F.size(T.words(F.col("text")))
    return spread(table(spark, folder, "documents")).select("doc_id", F.explode(chunking.window_starts(n, 50, 20)).alias("start_word"))


def _windows_sql(size: int, overlap: int) -> str:
    return f"""WITH {X.PAGES}, w AS (SELECT *, {X.words('text')} AS ws FROM pages_),
    s AS (SELECT *, unnest({X.starts('len(ws)', size, overlap)}) AS st FROM w)
    SELECT page_no, st // {size - overlap} + 1 AS chunk_no, st::INTEGER AS start_word, printf('%02d-%03d', page_no, st // {size - overlap} + 1) AS chunk_id,
    book, chapter, section, source_url, array_to_string(ws[st + 1 : st + {size}], ' ') AS text FROM s"""


@query(_windows_sql(500, 100))
def chunk_windows(spark, folder):
    return chunking.windows(X.pages(spark, folder))


@query(f"WITH {X.PAGES}, {X.chunk_ctes()} SELECT * FROM chunks_")
def chunk_pages(spark, folder):
    return X.chunks(spark, folder)


@query(
    f"""WITH {X.PAGES}, {X.chunk_ctes(300, 50)}, d AS (SELECT * REPLACE (CASE WHEN page_no % 7 = 0 THEN chr(160) || chr(10) ELSE text END AS text) FROM chunks_)
    SELECT page_no, chunk_no, chunk_id, book, chapter, section, source_url, text AS page_content FROM d WHERE {X.strip('text')} <> ''"""
)
def documents_nonempty(spark, folder):
    text = F.when(F.col("page_no") % 7 == 0, " \n").otherwise(F.col("text"))
    kept = chunking.nonempty(X.chunks(spark, folder, 300, 50).withColumn("text", text))
    return kept.drop("start_word").withColumnRenamed("text", "page_content")


@query(
    f"""WITH {X.PAGES}, {X.chunk_ctes()}, p AS (SELECT count(*) AS pages, count(*) FILTER (text IS NULL OR {X.strip('text')} = '') AS empty_pages FROM pages_)
    SELECT pages, empty_pages, (SELECT count(*) FROM chunks_) AS chunks FROM p"""
)
def index_summary(spark, folder):
    pages = X.pages(spark, folder)
    total = pages.agg(F.count("*").alias("pages"), F.count_if(T.strip(F.coalesce("text", F.lit(""))) == "").alias("empty_pages"))
    return total.join(F.broadcast(X.chunks(spark, folder).agg(F.count("*").alias("chunks"))))


# --- vectors ---

_cells = """WITH t AS (SELECT item_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS b, count(*) AS c
    FROM (SELECT item_id, unnest({words}) AS t FROM benchmark) GROUP BY ALL)
    SELECT item_id, b AS bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY item_id)), 9) AS weight FROM t"""


@query(_cells.format(words=X.words("text")))
def embed_hash(spark, folder):
    cells = table(spark, folder, "benchmark").select("item_id", F.posexplode(embedding.passages(F.col("text"))).alias("bucket", "weight"))
    return cells.where("weight <> 0").select("item_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 9).alias("weight"))


@query(SQL["chunk_windows"])
def sql_windows(spark, folder):
    """The windows by the functions of SQL text."""
    S.register(spark)
    return spark.sql(
        """SELECT page_no, chunk_no, start_word, chunk_id(page_no, chunk_no) AS chunk_id, book, chapter, section, source_url, text FROM (
            SELECT page_no, book, chapter, section, source_url, word_windows(text, 500, 100) AS ws FROM {pages}) LATERAL VIEW OUTER inline(ws) w
        WHERE chunk_no IS NOT NULL""",
        pages=X.pages(spark, folder),
    )


@query(
    f"""WITH {X.PAGES}, {X.chunk_ctes()}, t AS (SELECT page_no, chunk_no, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS b, count(*) AS c
    FROM (SELECT page_no, chunk_no, unnest({X.words('text')}) AS t FROM chunks_) GROUP BY ALL)
    SELECT page_no, chunk_no, count(*) AS used, round(max(c) / sqrt(sum(c * c)), 6) AS largest, arg_max(b, (c, -b)) AS top_bucket, 1.0::DOUBLE AS norm
    FROM t GROUP BY page_no, chunk_no"""
)
def vector_index(spark, folder):
    v = F.col("embedding")
    return X.index(spark, folder).select(
        "page_no",
        "chunk_no",
        F.size(F.filter(v, lambda x: x != 0)).cast("long").alias("used"),
        F.round(F.array_max(v), 6).alias("largest"),
        (F.array_position(v, F.array_max(v)) - 1).alias("top_bucket"),
        F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"),
    )


@query(
    """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 9) AS score
    FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, round(score, 6) AS score
    FROM p QUALIFY rank <= 10"""
)
def vector_topk(spark, folder):
    """Every vector whose id is divisible by 50 asks, and all vectors are searched."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(asked, rows, 10, ("vec_id",)).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


_topk = SQL["vector_topk"]


def _vectors(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_topk)
def vector_topk_pruned(spark, folder):
    """The same questions against a clustered index, which is built here; what cannot count is skipped, so the result is the same."""
    rows, asked = _vectors(spark, folder)
    index = pruning.build(spark, rows, ("vec_id",), fresh_path(spark, "clustered"))
    return pruning.search(asked, index, 10)[0].select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def vector_topk_lsh(spark, folder):
    """The same questions by bands of hyperplanes, an explicit option: at least 0.9 of the exact hits, which tests measure; so it has no SQL."""
    ship(spark)
    rows, asked = _vectors(spark, folder)
    buckets = lsh.build(spark, rows, ("vec_id",), fresh_path(spark, "buckets"))
    return lsh.search(asked, buckets, 10).withColumn("score", F.round("score", 6))


QUERIES["vector_topk_lsh"] = vector_topk_lsh


# --- retrieval ---

_hits = f"WITH {X.PAGES}, {X.chunk_ctes()}, {X.hit_ctes()}"


@query(f"{_hits} SELECT * FROM hits_")
def retrieve_topk(spark, folder):
    return X.hits(spark, folder)


@query(f"WITH {X.PAGES}, {X.chunk_ctes()}, {X.hit_ctes(max_score=X.THRESHOLD)} SELECT query_id, rank, page_no, chunk_no, score, passes_threshold FROM hits_")
def retrieve_only_passing(spark, folder):
    return X.hits(spark, folder, only_passing=True).select("query_id", "rank", "page_no", "chunk_no", "score", "passes_threshold")


@query(SQL["retrieve_only_passing"])
def retrieve_pruned(spark, folder):
    """The gated hits from a clustered index of the same chunks: the gate's distance bounds what is met."""
    held = X.index(spark, folder)
    index = pruning.build(spark, held, retrieval.PLACE, fresh_path(spark, "clustered"))
    return pruning.retrieve(X.questions(spark, folder), index, held, X.K, X.THRESHOLD).select("query_id", "rank", "page_no", "chunk_no", "score", "passes_threshold")


@query(f"{_hits} SELECT query_id, rank, score, score <= 0.9 AS passes FROM hits_")
def threshold_pass(spark, folder):
    return X.hits(spark, folder).select("query_id", "rank", "score", retrieval.passes(F.col("score"), 0.9).alias("passes"))


@query("SELECT vec_id, round(greatest(-1, least(1, 1 - ((vec_id % 300) / 100.0) ** 2 / 2)), 9)::DOUBLE AS cosine FROM embeddings")
def l2_to_cosine(spark, folder):
    distance = (F.col("vec_id") % 300) / 100.0
    return table(spark, folder, "embeddings").select("vec_id", F.round(retrieval.cosine_from_score(distance), 9).alias("cosine"))


@query("SELECT item_id AS query_id, 0::BIGINT AS hits, '" + NO_ANSWER + "' AS answer, false AS found FROM benchmark")
def empty_question(spark, folder):
    """Questions of white space alone: no hits, and the fixed answer."""
    asked = X.questions(spark, folder).withColumn("question", F.lit("  \n"))
    hits = retrieval.retrieve(asked, X.index(spark, folder), X.K, X.THRESHOLD)
    counts = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    out = answering.answers(asked, hits).join(counts, "query_id", "left")
    return out.select("query_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "answer", "found")


@query(f"{_hits} SELECT query_id, score AS best_score, passes_threshold AS open FROM hits_ WHERE rank = 1")
def rag_gate(spark, folder):
    return answering.gate(X.hits(spark, folder))


_found = f"{_hits}, found_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS context_no FROM hits_ WHERE passes_threshold QUALIFY context_no <= 3)"


@query(f"{_found} SELECT query_id, context_no, rank, chunk_id, chapter, score FROM found_")
def generation_context(spark, folder):
    return answering.contexts(X.hits(spark, folder)).select("query_id", "context_no", "rank", "chunk_id", "chapter", "score")


_prompt = f"""{_found}, blocks_ AS (SELECT query_id, string_agg('[' || context_no || '] {answering.CHAPTER}' ||
    CASE WHEN section = '' THEN chapter ELSE chapter || ' / ' || section END || chr(10) || '{answering.SOURCE}' || source_url || chr(10) || '{answering.BODY}' || chr(10)
    || {X.strip('text')}, chr(10) || chr(10) ORDER BY context_no) AS context FROM found_ GROUP BY query_id),
    prompts_ AS (SELECT query_id, '{answering.INTRO}' || chr(10) || context || chr(10) || chr(10) || '{answering.QUESTION}' || {X.strip('b.text')} || chr(10) || chr(10)
    || '{answering.REMINDER}' AS prompt FROM blocks_ JOIN benchmark b ON item_id = query_id)"""


@query(f"{_prompt} SELECT * FROM prompts_")
def prompt_context(spark, folder):
    return answering.prompts(answering.contexts(X.hits(spark, folder)), X.questions(spark, folder))


_sources = """, first_ AS (SELECT query_id, context_no AS place, book, chapter, section, source_url FROM found_
    QUALIFY row_number() OVER (PARTITION BY query_id, chapter, source_url ORDER BY context_no) = 1)"""


@query(
    f"""{_found}{_sources}, said_ AS (SELECT query_id, array_to_string(string_split(text, ' ')[1:20], ' ') AS said FROM found_ WHERE context_no = 1),
    listed_ AS (SELECT query_id, string_agg(chapter || '@' || source_url, ',' ORDER BY place) AS sources FROM first_ GROUP BY query_id)
    SELECT b.item_id AS query_id, coalesce(said, '{NO_ANSWER}') AS answer, said IS NOT NULL AS found, coalesce(sources, '') AS sources
    FROM benchmark b LEFT JOIN said_ s ON s.query_id = b.item_id LEFT JOIN listed_ l ON l.query_id = b.item_id"""
)
def answers(spark, folder):
    out = answering.answers(X.questions(spark, folder), X.hits(spark, folder))
    listed = F.array_join(F.transform("sources", lambda s: F.concat(s["chapter"], F.lit("@"), s["source_url"])), ",")
    return out.select("query_id", "answer", "found", listed.alias("sources"))


@query(
    f"""SELECT item_id, CASE item_id % 4 WHEN 0 THEN chr(160) WHEN 1 THEN text || '{NO_ANSWER}' ELSE text END AS said, item_id % 4 IN (0, 1) AS no_answer FROM benchmark"""
)
def no_answer_flag(spark, folder):
    kind = F.col("item_id") % 4
    said = F.when(kind == 0, " ").when(kind == 1, F.concat("text", F.lit(NO_ANSWER))).otherwise(F.col("text"))
    return table(spark, folder, "benchmark").select("item_id", said.alias("said")).withColumn("no_answer", answering.is_no_answer(F.col("said")))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'error' WHEN role <> 'assistant' THEN 'warning' ELSE 'answer' END AS shown_as,
    CASE WHEN turn % 4 = 3 THEN 'lost' WHEN role <> 'assistant' THEN '""" + NO_ANSWER + """' ELSE """ + X.strip("text") + """ END AS shown_text FROM conversations"""
)
def answer_payload(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "lost").alias("error"), F.col("text").alias("content"), (F.col("role") == "assistant").alias("found"))
    return answering.shown(rows).select("conv_id", "turn", "shown_as", "shown_text")


# --- citations ---


def _cite(part: str) -> str:
    return f"nullif({X.strip(part)}, '')"


_label = f"concat_ws(', ', {_cite('book')}, {_cite('chapter')}, {_cite('section')})"
_citation = f"CASE WHEN {_label} = '' THEN '{citations.UNNAMED}' ELSE {_label} END || CASE WHEN {X.strip('source_url')} = '' THEN '' ELSE ' — ' || {X.strip('source_url')} END"
_blanked = "blanked_ AS (SELECT page_no, CASE WHEN page_no % 2 = 0 THEN ' ' ELSE book END AS book, CASE WHEN page_no % 3 = 0 THEN '' ELSE chapter END AS chapter, CASE WHEN page_no % 5 = 0 THEN chr(160) ELSE section END AS section, CASE WHEN page_no % 7 = 0 THEN '' ELSE source_url END AS source_url FROM pages_)"


def _blank_parts(spark, folder):
    no = F.col("page_no")
    rows = X.pages(spark, folder)
    for c, m, v in (("book", 2, " "), ("chapter", 3, ""), ("section", 5, " "), ("source_url", 7, "")):
        rows = rows.withColumn(c, F.when(no % m == 0, v).otherwise(F.col(c)))
    return rows


@query(f"WITH {X.PAGES}, {_blanked} SELECT page_no, {_citation} AS citation FROM blanked_")
def format_citation(spark, folder):
    parts = (F.col(c) for c in ("book", "chapter", "section", "source_url"))
    return _blank_parts(spark, folder).select("page_no", citations.format_citation(*parts).alias("citation"))


@query(f"WITH {X.PAGES}, {_blanked} SELECT page_no, CASE WHEN concat_ws(' / ', {_cite('chapter')}, {_cite('section')}) = '' THEN '—' ELSE concat_ws(' / ', {_cite('chapter')}, {_cite('section')}) END AS location FROM blanked_")
def source_location(spark, folder):
    return _blank_parts(spark, folder).select("page_no", citations.location(F.col("chapter"), F.col("section")).alias("location"))


_records = f"""{_hits}, first_ AS (SELECT * FROM hits_ QUALIFY row_number() OVER (PARTITION BY query_id, chapter, source_url ORDER BY rank) = 1),
    records_ AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position, book, chapter, section, source_url FROM first_)"""


@query(f"{_records} SELECT * FROM records_")
def source_records(spark, folder):
    return citations.source_records(X.hits(spark, folder))


@query(f"{_records} SELECT query_id, position, {_citation} AS citation FROM records_", "citations")
def cited_sources(spark, folder):
    return citations.citations(X.hits(spark, folder))


# --- evaluation ---

_eval = f"""{_hits}, {X.GOLD}, rows_ AS (SELECT g.query_id, g.type, g.expected_chapter,
    coalesce(list(h.chapter ORDER BY h.rank) FILTER (h.rank IS NOT NULL), []) AS chapters, min(h.score) AS best_score,
    coalesce(bool_or(h.passes_threshold AND h.rank = 1), false) AS passes_threshold
    FROM gold_ g LEFT JOIN hits_ h USING (query_id) GROUP BY ALL),
    eval_ AS (SELECT *, CASE WHEN type = 'answerable' THEN list_contains(chapters, coalesce(expected_chapter, '')) END AS hit FROM rows_)"""


def _evaluated(spark, folder):
    return evaluation.eval_rows(X.gold(spark, folder), X.hits(spark, folder))


@query(f"{_eval} SELECT query_id, hit FROM eval_ WHERE type = 'answerable'")
def chapter_hit(spark, folder):
    return _evaluated(spark, folder).where("type = 'answerable'").select("query_id", "hit")


@query(f"{_eval} SELECT query_id, type, expected_chapter, array_to_string(chapters, ',') AS retrieved_chapters, best_score, passes_threshold, hit FROM eval_")
def eval_rows(spark, folder):
    return _evaluated(spark, folder).withColumn("retrieved_chapters", F.array_join("retrieved_chapters", ",")).drop("scores")


_counts = """count_if(type = 'answerable')::BIGINT AS answerable, count_if(coalesce(hit, false))::BIGINT AS hits,
    count_if(coalesce(hit, false)) / nullif(count_if(type = 'answerable'), 0) AS hit_rate"""


@query(
    f"""{_eval} SELECT 5::BIGINT AS k, {X.THRESHOLD}::DOUBLE AS threshold, {_counts},
    count_if(type = 'answerable' AND passes_threshold)::BIGINT AS threshold_passes,
    count_if(type = 'answerable' AND passes_threshold) / nullif(count_if(type = 'answerable'), 0) AS threshold_pass_rate,
    count_if(type = 'unanswerable')::BIGINT AS unanswerable, count_if(type = 'unanswerable' AND NOT passes_threshold)::BIGINT AS unanswerable_gated FROM eval_"""
)
def eval_summary(spark, folder):
    return evaluation.eval_summary(_evaluated(spark, folder), X.K, X.THRESHOLD)


def _strategy(name: str, label: str, size: int, overlap: int) -> str:
    c, h = f"chunks_{name}", f"hits_{name}"
    rows = f"""rows_{name} AS (SELECT g.query_id, g.type, coalesce(bool_or(h.chapter = g.expected_chapter), false) AS hit FROM gold_ g LEFT JOIN {h} h USING (query_id) GROUP BY ALL)"""
    select = f"""SELECT '{name}' AS id, '{label}' AS label, {size}::BIGINT AS chunk_size, {overlap}::BIGINT AS overlap, (SELECT count(*) FROM {c}) AS n_chunks,
        count_if(hit AND type = 'answerable')::BIGINT AS hits, count_if(type = 'answerable')::BIGINT AS answerable,
        count_if(hit AND type = 'answerable') / nullif(count_if(type = 'answerable'), 0) AS hit_rate FROM rows_{name}"""
    return f"{X.chunk_ctes(size, overlap, name=c)}, {X.hit_ctes(c, h)}, {rows}", select


_parts = [_strategy(*s) for s in evaluation.STRATEGIES]


@query(f"WITH {X.PAGES}, {X.GOLD}, {', '.join(p[0] for p in _parts)} {' UNION ALL '.join(p[1] for p in _parts)}")
def compare_chunking(spark, folder):
    asked, gold = X.questions(spark, folder), X.gold(spark, folder)
    parts = {}
    for name, _, size, overlap in evaluation.STRATEGIES:
        index = X.index(spark, folder, size, overlap)
        parts[name] = (evaluation.eval_rows(gold, retrieval.retrieve(asked, index, X.K, X.THRESHOLD)), index)
    return evaluation.compare(parts)


@query(
    f"""{_eval} SELECT query_id, '[' || type || '] best ' || CASE WHEN best_score IS NULL THEN 'n/a' ELSE printf('%.4f', best_score) END || ' gate ' ||
    CASE WHEN passes_threshold THEN 'PASS' ELSE 'FAIL' END || ' chapter ' || CASE WHEN type <> 'answerable' THEN '-' WHEN hit THEN 'HIT' ELSE 'MISS' END AS line FROM eval_"""
)
def eval_report(spark, folder):
    return evaluation.report(_evaluated(spark, folder))


@query(
    f"""{_eval}, s_ AS (SELECT count_if(type = 'answerable') AS a, count_if(coalesce(hit, false)) AS h, count_if(type = 'answerable' AND passes_threshold) AS p,
    count_if(type = 'unanswerable') AS u, count_if(type = 'unanswerable' AND NOT passes_threshold) AS g FROM eval_)
    SELECT 0::INTEGER AS line_no, 'hit rate: ' || h || '/' || a || ' = ' || CASE WHEN a = 0 THEN 'n/a' ELSE printf('%.2f%%', h / a * 100) END AS line FROM s_
    UNION ALL SELECT 1, 'threshold passes: ' || p || '/' || a || ' = ' || CASE WHEN a = 0 THEN 'n/a' ELSE printf('%.2f%%', p / a * 100) END FROM s_
    UNION ALL SELECT 2, 'unanswerable gated: ' || g || '/' || u FROM s_"""
)
def summary_report(spark, folder):
    return evaluation.summary_lines(evaluation.eval_summary(_evaluated(spark, folder), X.K, X.THRESHOLD))


# --- URLs ---

_origin = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
_path = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
_title = f"nullif(trim(replace(substr({_path}, 2), '_', ' ')), '')"


@query(f"SELECT page_id, {_origin} || '/w/index.php?title=Special:PrefixIndex&namespace=0&prefix=' || replace(url_encode(url || ' é'), '%2F', '/') AS listing FROM pages")
def prefix_index_url(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", U.prefix_listing_url(F.col("url"), F.concat("url", F.lit(" é"))).alias("listing"))


@query(f"SELECT page_id, {_title} AS title FROM pages")
def title_from_url(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", U.title_from_url(F.col("url"), X.PAGE_PATH).alias("title"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS canonical FROM pages")
def canonical_url(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", U.canonical_url(F.col("url"), F.lit("http://base.example/")).alias("canonical"))


@query("SELECT page_id, url_decode(replace(replace(url, '?', '%3F'), '+', '%2B')) AS shown FROM pages")
def display_url(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", U.unquoted(F.replace("url", F.lit("?"), F.lit("%3F"))).alias("shown"))


_host = "ltrim(lower(regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1)), 'w.')"
_other = "(CASE page_id % 3 WHEN 0 THEN replace(url, '://', '://www.') WHEN 1 THEN upper(url) ELSE 'https://other.example/x' END)"


@query(f"SELECT page_id, {_host.format(u='url')} <> '' AND {_host.format(u='url')} = {_host.format(u=_other)} AS allowed FROM pages")
def host_allowed(spark, folder):
    kind = F.col("page_id") % 3
    other = F.when(kind == 0, F.replace("url", F.lit("://"), F.lit("://www."))).when(kind == 1, F.upper("url")).otherwise("https://other.example/x")
    return spread(table(spark, folder, "pages")).select("page_id", U.host_allowed(F.col("url"), other).alias("allowed"))


_prefixes = [*U.SKIPPED_NAMESPACES, "special:", "", "Special"]
_named = f"(list_value({', '.join(repr(p) for p in _prefixes)})[page_id % {len(_prefixes)} + 1] || 'X')"
_flagged = "(url || CASE page_id % 11 WHEN 0 THEN '&Action=Edit' WHEN 1 THEN '&redlink=1' ELSE '' END)"
_namespace = " ".join(f"WHEN starts_with(t, '{p}') THEN 'namespace {p[:-1]}'" for p in U.SKIPPED_NAMESPACES)
_reason = f"""CASE WHEN lower(u) LIKE '%action=edit%' OR lower(u) LIKE '%redlink=1%' THEN 'edit/redlink' WHEN t IS NULL THEN 'not a wiki title'
    WHEN starts_with(t, '{U.SKIPPED_NAMESPACES[0]}') OR starts_with(lower(t), 'special:') THEN 'special page' {_namespace} END"""


@query(f"SELECT page_id, {_reason} AS reason FROM (SELECT page_id, {_flagged} AS u, CASE WHEN page_id % 13 <> 2 THEN {_named} END AS t FROM pages)")
def skip_reason(spark, folder):
    id_ = F.col("page_id")
    names = F.array(*[F.lit(p) for p in _prefixes])
    title = F.when(id_ % 13 != 2, F.concat(F.get(names, (id_ % len(_prefixes)).cast("int")), F.lit("X")))
    url = F.concat("url", F.when(id_ % 11 == 0, "&Action=Edit").when(id_ % 11 == 1, "&redlink=1").otherwise(""))
    return spread(table(spark, folder, "pages")).select("page_id", U.skip_reason(title, url).alias("reason"))


_root = "'en'"


@query(f"SELECT page_id, {_title} = {_root} OR starts_with({_title}, {_root} || '/') AS belongs FROM pages")
def belongs_to_root(spark, folder):
    title = U.title_from_url(F.col("url"), X.PAGE_PATH)
    return spread(table(spark, folder, "pages")).select("page_id", title.alias("title")).select("page_id", U.belongs_to(F.col("title"), F.lit("en")).alias("belongs"))


@query(
    f"""WITH t AS (SELECT page_id, {_title} || CASE page_id % 3 WHEN 0 THEN '//a/b' WHEN 1 THEN '' ELSE '/z' END AS t, string_split({_title}, '/')[1] AS r FROM pages),
    p AS (SELECT *, list_filter(string_split(CASE WHEN starts_with(t, r) THEN ltrim(substr(t, length(r) + 1), '/') ELSE t END, '/'), lambda x: x <> '') AS parts FROM t)
    SELECT page_id, CASE WHEN t = r THEN r ELSE coalesce(parts[1], '') END AS chapter, CASE WHEN t = r THEN '' ELSE array_to_string(parts[2:], '/') END AS section FROM p"""
)
def chapter_section(spark, folder):
    kind = F.col("page_id") % 3
    title = U.title_from_url(F.col("url"), X.PAGE_PATH)
    rows = spread(table(spark, folder, "pages")).select("page_id", title.alias("t"))
    rows = rows.select("page_id", F.concat("t", F.when(kind == 0, "//a/b").when(kind == 1, "").otherwise("/z")).alias("title"), F.substring_index("t", "/", 1).alias("root"))
    chapter, section = U.chapter_and_section(F.col("title"), F.col("root"))
    return rows.select("page_id", chapter.alias("chapter"), section.alias("section"))


# --- HTML and discovery ---

_article = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_text_of = f"regexp_replace(regexp_replace({_article}, '(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', chr(10), 'g'), '(?s)<!--.*?-->|<[^>]*>', chr(10), 'g')"
# Old entities count without their semicolon too.
for _a, _b in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")):
    _text_of = f"regexp_replace({_text_of}, '&{_a};?', '{_b}', 'g')"
_lines = f"list_filter(list_transform(string_split({_text_of}, chr(10)), lambda x: {X.strip('''regexp_replace(x, '[ \\t]+', ' ', 'g')''')}), lambda x: x <> '')"
_extracted = f"array_to_string({_lines}, chr(10))"


def _fixture_text(column):
    return H.extract_text(column, X.HTML_ROOTS)


@query(f"SELECT page_id, {_extracted} AS text FROM pages")
def extract_text(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", _fixture_text(F.col("html")).alias("text"))


@query("SELECT page_id, page_id % 4 = 0 AS missing FROM pages")
def missing_page(spark, folder):
    marked = F.when(F.col("page_id") % 4 == 0, F.replace("html", F.lit("<footer>"), F.lit('<p class="x noarticletext">gone</p><footer>'))).otherwise(F.col("html"))
    return spread(table(spark, folder, "pages")).select("page_id", H.is_missing(marked).alias("missing"))


_href = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"


@query(f"SELECT page_id, url, unnest(range(0, len({_href}))) AS link_no, unnest({_href}) AS href FROM pages")
def page_links(spark, folder):
    return discovery.page_links(spread(table(spark, folder, "pages")))


@query(SQL["page_links"])
def sql_page_links(spark, folder):
    """The links by the table function that takes a whole table."""
    S.register(spark)
    return spark.sql("SELECT * FROM page_links(TABLE(SELECT page_id, url, html FROM {pages}))", pages=spread(table(spark, folder, "pages")))


_host_of = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
_links = f"""links_ AS (SELECT page_id, url, unnest(range(0, len({_href}))) AS link_no, unnest({_href}) AS href FROM pages),
    titled_ AS (SELECT *, nullif(trim(replace(regexp_replace(ltrim(href, '/'), '[?#].*$', ''), '_', ' ')), '') AS t,
        left(regexp_replace(ltrim(href, '/'), '[?#].*$', ''), 1) AS root FROM links_),
    judged_ AS (SELECT *, CASE WHEN t IS NULL THEN 'not a wiki title' WHEN NOT (t = root OR starts_with(t, root || '/')) THEN 'outside hierarchy' END AS reason FROM titled_)"""


def _judged(spark, folder):
    """A link's root is the first letter of what it names, so that one-letter names are roots and others lie outside."""
    links = discovery.page_links(spread(table(spark, folder, "pages")))
    links = links.withColumn("root", F.substring(F.regexp_replace(F.ltrim("href", F.lit("/")), "[?#].*$", ""), 1, 1))
    return discovery.judge_links(links, X.PAGE_PATH)


@query(f"WITH {_links} SELECT page_id, link_no, t AS title, reason FROM judged_")
def judged_links(spark, folder):
    return _judged(spark, folder).select("page_id", "link_no", "title", "reason")


_toc = "regexp_replace(ltrim(href, '/'), '[?#].*$', '')"


@query(
    f"""WITH l AS (SELECT page_id, unnest(range(0, len({_href}))) AS link_no, unnest({_href}) AS href FROM pages),
    j AS (SELECT page_id, link_no, 'en/' || {_toc} AS t FROM l WHERE {_toc} <> ''),
    f AS (SELECT page_id, min(link_no) AS link_no, t AS title FROM j GROUP BY page_id, t)
    SELECT page_id, link_no, title, (SELECT count(*) FROM l WHERE l.page_id = f.page_id AND {_toc} = '') AS skipped FROM f"""
)
def toc_links(spark, folder):
    """The pages' links as a table of contents of the root ``en``."""
    links = discovery.page_links(spread(table(spark, folder, "pages"))).withColumn("root", F.lit("en"))
    # The fixture's links name no root, so one is put before each.
    links = links.withColumn("href", F.when(F.ltrim("href", F.lit("/")) != "", F.concat(F.lit("/en/"), F.ltrim("href", F.lit("/")))).otherwise("/"))
    # Both results read the judged links, whose pages are parsed once.
    judged = materialize(spark, discovery.judge_links(links, X.PAGE_PATH).select("page_id", "link_no", "title", "reason", "root"), "judged")
    titles, skipped = discovery.toc_titles(judged)
    return titles.join(skipped, "page_id")


@query(
    f"""WITH a AS (SELECT 0 AS source_no, page_id AS place, {_title} AS title FROM pages UNION ALL
    SELECT 1, item_id, 'en/' || (item_id * 7 % 1000) FROM benchmark)
    SELECT source_no::BIGINT AS source_no, place, title FROM a WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY source_no, place) = 1"""
)
def ordered_union_distinct(spark, folder):
    first = spread(table(spark, folder, "pages")).select(F.col("page_id").alias("place"), U.title_from_url(F.col("url"), X.PAGE_PATH).alias("title")).where("title is not null")
    second = table(spark, folder, "benchmark").select(F.col("item_id").alias("place"), F.concat(F.lit("en/"), (F.col("item_id") * 7 % 1000).cast("string")).alias("title"))
    return discovery.ordered_union([first, second], "title", "place")


def _listed(spark, folder):
    """Titles of all pages, and their roots as pages of their own."""
    titles = spread(table(spark, folder, "pages")).select(U.title_from_url(F.col("url"), X.PAGE_PATH).alias("title")).where("title is not null")
    return titles.unionByName(titles.select(F.substring_index("title", "/", 1).alias("title")))


@query(
    f"""WITH t AS (SELECT DISTINCT {_title} AS t FROM pages WHERE {_title} IS NOT NULL), r AS (SELECT DISTINCT string_split(t, '/')[1] AS r FROM t)
    SELECT r AS root FROM r ORDER BY (SELECT count(*) FROM t WHERE starts_with(t, r || '/')) DESC, length(r), r LIMIT 1"""
)
def choose_root(spark, folder):
    return discovery.choose_root(_listed(spark, folder), "no such title")


def _crawled(spark, folder):
    """Pages as fetched: some failed, some refused, some marked missing, some outside, some empty."""
    rows = spread(table(spark, folder, "pages"))
    id_ = F.col("page_id")
    html = F.when(id_ % 5 == 1, F.replace("html", F.lit("<article>"), F.lit('<article><i class="noarticletext"></i>')))
    html = html.when(id_ % 7 == 2, F.lit("<article></article>")).otherwise(F.col("html"))
    rows = rows.select((id_ + 1).alias("page_no"), "url", F.when(id_ % 11 != 0, F.when(id_ % 11 == 4, 404).otherwise(200)).alias("status"), html.alias("html"))
    rows = rows.select("page_no", "url", "status", H.content(F.col("html"), X.HTML_ROOTS).alias("page"), U.title_from_url(F.col("url"), X.PAGE_PATH).alias("title"), F.lit("en").alias("root"))
    return discovery.outcomes(rows.select("page_no", "url", "status", "page.missing", "title", "page.text", "root"))


_out = f"""crawl_ AS (SELECT page_id + 1 AS page_no, url, {_title} AS title, CASE WHEN page_id % 7 = 2 AND page_id % 5 <> 1 THEN '' ELSE {_extracted} END AS text,
    CASE WHEN page_id % 11 = 0 THEN 'fetch failed' WHEN page_id % 11 = 4 THEN 'http error' WHEN page_id % 5 = 1 THEN 'missing'
    WHEN NOT coalesce({_title} = 'en' OR starts_with({_title}, 'en/'), false) THEN 'outside' WHEN page_id % 7 = 2 THEN 'empty' ELSE 'page' END AS outcome FROM pages),
    records_ AS (SELECT page_no, 'the book' AS book, CASE WHEN title = 'en' THEN 'en' ELSE list_filter(string_split(substr(title, 4), '/'), lambda x: x <> '')[1] END AS chapter,
    CASE WHEN title = 'en' THEN '' ELSE array_to_string(list_filter(string_split(substr(title, 4), '/'), lambda x: x <> '')[2:], '/') END AS section,
    url AS source_url, title, text, length(text)::INTEGER AS char_count FROM crawl_ WHERE outcome = 'page')"""


@query(f"WITH {_out} SELECT outcome, count(*) AS pages FROM crawl_ GROUP BY outcome")
def crawl_outcomes(spark, folder):
    return _crawled(spark, folder).groupBy("outcome").agg(F.count("*").alias("pages"))


@query(f"WITH {_out} SELECT * FROM records_")
def page_records(spark, folder):
    return discovery.records(_crawled(spark, folder), "the book")


@query(f"WITH {_out} SELECT count(*) AS pages, sum(char_count)::BIGINT AS chars, arg_min(chapter, page_no) AS first_chapter, arg_max(chapter, page_no) AS last_chapter FROM records_")
def crawl_summary(spark, folder):
    return discovery.summary(discovery.records(_crawled(spark, folder), "the book"))


@query(
    f"""WITH t AS (SELECT page_id, {_title} AS title FROM pages), r AS (SELECT DISTINCT string_split(title, '/')[1] AS r FROM t WHERE title IS NOT NULL),
    best AS (SELECT r FROM r ORDER BY (SELECT count(DISTINCT title) FROM t WHERE starts_with(title, r || '/')) DESC, length(r), r LIMIT 1),
    kept AS (SELECT min(page_id) AS place, title FROM t, best WHERE starts_with(title, r || '/') GROUP BY title)
    SELECT row_number() OVER (ORDER BY place) AS position, 'https://host.example/wiki/' || replace(title, ' ', '_') AS url FROM kept"""
)
def discover_pages(spark, folder):
    """The chosen root's pages in listing order, as URLs."""
    titles = spread(table(spark, folder, "pages")).select("page_id", U.title_from_url(F.col("url"), X.PAGE_PATH).alias("title")).where("title is not null")
    root = discovery.choose_root(_listed(spark, folder), "no such title")
    mine = titles.join(F.broadcast(root), U.belongs_to(F.col("title"), F.col("root")) & (F.col("title") != F.col("root")))
    kept = materialize(spark, discovery.ordered_distinct(mine, "title", ["page_id"]), "contents")
    placed = ordering.positions(spark, kept, "root", ["page_id"])
    return placed.select((F.col("position") + 1).alias("position"), F.concat(F.lit("https://host.example/wiki/"), F.replace("title", F.lit(" "), F.lit("_"))).alias("url"))


# --- conversations, errors, models ---


@query(
    """SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question,
    CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'"""
)
def chat_turns(spark, folder):
    return answering.chat_turns(table(spark, folder, "conversations"))


@query(
    """WITH e AS (SELECT *, turn % 9 = 8 AS reset FROM conversations),
    n AS (SELECT *, (count(*) FILTER (reset) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS epoch FROM e)
    SELECT conv_id::VARCHAR AS session, epoch, row_number() OVER (PARTITION BY conv_id, epoch ORDER BY turn, role, text) - 1 AS position, turn AS at, role, text AS content
    FROM n WHERE NOT reset"""
)
def chat_sessions(spark, folder):
    """Conversations as a stream of events, every ninth turn a reset, followed into a new folder and read back."""
    base = fresh_path(spark, "sessions")
    rows = sessions.stream(spark, f"{folder}/conversations.parquet", table(spark, folder, "conversations").schema)
    kind = F.when(F.col("turn") % 9 == 8, sessions.RESET).otherwise("message")
    events = rows.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("long").alias("at"), kind.alias("kind"), "role", F.col("text").alias("content"))
    sessions.follow(events, f"{base}/messages", f"{base}/checkpoint").awaitTermination()
    return sessions.transcript(spark, f"{base}/messages")


_errors = ["Index not found at x", "model 'm' not found", "qwen2.5:3b NOT FOUND", "try pulling it first", "Connection refused", "Max retries exceeded", "odd"]
_class = ["index_missing", "model_missing", "model_missing", "model_missing", "server_down", "server_down", "other"]


@query(f"SELECT item_id, list_value({', '.join(repr(c) for c in _class)})[item_id % {len(_errors)} + 1] AS class FROM benchmark")
def error_class(spark, folder):
    texts = F.array(*[F.lit(e) for e in _errors])
    return table(spark, folder, "benchmark").select("item_id", answering.error_class(F.get(texts, (F.col("item_id") % len(_errors)).cast("int"))).alias("class"))


@query("SELECT unnest(list_value('m' || item_id || ':latest', 'm' || item_id)) AS name FROM benchmark")
def model_names(spark, folder):
    id_ = F.col("item_id").cast("string")
    payload = F.concat(F.lit('{"models":[{"name":" m'), id_, F.lit(':latest ","model":"m'), id_, F.lit('"},{"name":" "}]}'))
    return answering.model_names(table(spark, folder, "benchmark").select(payload.alias("payload")))
