"""How the test tables stand for pages, questions and hits, in Spark and in SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import __version__
from quern.functions.text import REMOVED
from quern.operators import chunking, embedding, retrieval
from quern.shared import materialize, spread, written_once
from quern.shipping import ship
from quern.sources.index import vectors
from quern.sources.tables import table

THRESHOLD = 1.0
K = 5
HTML_ROOTS = (("article",),)
PAGE_PATH = "/"
#: Put into texts on both sides, as the tables hold no such characters: a decomposed letter, spaces, line breaks, invisible ones.
ODD = " é  \tx\r\n \n\n\n​y­z 　 w\u001cv \n"


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents")).select(
        (F.col("doc_id") + 1).alias("page_no"),
        F.col("lang").alias("book"),
        F.col("doc_id").cast("string").alias("chapter"),
        F.col("source").alias("section"),
        F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_url"),
        "text",
    )


def chunks(spark: SparkSession, folder: str, size: int = 500, overlap: int = 100) -> DataFrame:
    return chunking.chunk_pages(pages(spark, folder), size, overlap)


def index(spark: SparkSession, folder: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """The vector index of these documents and window sizes: the first query builds it, and the others read it."""
    key = ("index", folder, size, overlap, __version__)
    return written_once(spark, "index", table(spark, folder, "documents"), key, lambda: vectors(chunking.nonempty(chunks(spark, folder, size, overlap))))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return asked.withColumn("embedding", embedding.questions(F.col("question")))


def hits(spark: SparkSession, folder: str, only_passing: bool = False) -> DataFrame:
    return retrieval.retrieve(questions(spark, folder), index(spark, folder), K, THRESHOLD, only_passing)


def first_occurrences(documents: DataFrame, items: DataFrame, block: int = retrieval.BLOCK) -> DataFrame:
    """item_id, doc_id: the least document that holds an item's text, one pass over the documents for each block of different texts.

    A task gives one row a text at most, however many items share it and however many documents hold it.
    """
    spark = documents.sparkSession
    ship(spark)
    items = items.select("item_id", F.col("text").alias("sought")).where("sought <> ''")
    sought = items.select("sought").distinct()
    parts = max(1, -(-sought.count() // block))
    out = None
    for b in range(parts):
        # A block by count at most, up to the hash's evenness.
        own = sought.where(F.pmod(F.xxhash64("sought"), F.lit(parts)) == b) if parts > 1 else sought
        held = spark.sparkContext.broadcast([r["sought"] for r in own.collect()])

        def run(batches, held=held):
            import ahocorasick

            if not held.value:
                return
            found = ahocorasick.Automaton()
            for number, text in enumerate(held.value):
                found.add_word(text, number)
            found.make_automaton()
            least: dict[int, int] = {}
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for _, number in found.iter(text or ""):
                        if least.get(number, doc) >= doc:
                            least[number] = doc
            texts = [held.value[number] for number in least]
            yield pa.RecordBatch.from_pydict({"sought": pa.array(texts, pa.string()), "doc_id": pa.array(list(least.values()), pa.int64())})

        one = documents.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, "sought string, doc_id long")
        if parts > 1:  # one block's texts at a time in memory
            one = materialize(spark, one, "occurrences")
            held.destroy()
        out = one if out is None else out.unionByName(one)
    least = out.groupBy("sought").agg(F.min("doc_id").alias("doc_id"))
    return items.join(least, "sought").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, question, type, expected_chapter: an item is answerable if a document holds its text; the first is the gold."""
    items = table(spark, folder, "benchmark")
    found = first_occurrences(spread(table(spark, folder, "documents")), items).select("item_id", F.col("doc_id").cast("string").alias("expected_chapter"))
    rows = items.join(found, "item_id", "left")
    kind = F.when(F.col("expected_chapter").isNull(), "unanswerable").otherwise("answerable")
    return rows.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), kind.alias("type"), "expected_chapter")


# --- the same in SQL ---

WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = r"[ \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"
BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def lit(text: str) -> str:
    """A SQL literal that spells out what isn't plain."""
    out = " || ".join(f"chr({ord(c)})" if not c.isprintable() or ord(c) > 126 else "'" + c.replace("'", "''") + "'" for c in text)
    return f"({out})" if text else "''"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def words(e: str) -> str:
    return f"list_filter(string_split_regex({e}, '{WS}+'), lambda x: x <> '')"


def clean(e: str) -> str:
    e = f"regexp_replace(nfc_normalize({e}), '\\r\\n?', chr(10), 'g')"
    e = f"regexp_replace({e}, '[{''.join(f'\\x{{{ord(c):x}}}' for c in REMOVED)}]', '', 'g')"
    e = f"regexp_replace({e}, '{SPACES}', ' ', 'g')"
    e = f"regexp_replace({e}, '[ \\t]*\\n[ \\t]*', chr(10), 'g')"
    return strip(f"regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def heading(e: str, h: str) -> str:
    first = f"string_split_regex({e}, '{BREAK}')[1]"
    rest = strip(f"array_to_string(string_split_regex({e}, '{BREAK}')[2:], chr(10))")
    return f"CASE WHEN {e} = '' OR {h} = '' THEN {e} WHEN {strip(first)} = {strip(f'nfc_normalize({h})')} THEN {rest} ELSE {e} END"


PAGES = """pages_ AS (SELECT doc_id + 1 AS page_no, lang AS book, doc_id::VARCHAR AS chapter, source AS section,
    'doc://' || source || '/' || doc_id AS source_url, text FROM documents)"""


def starts(n: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"CASE WHEN {n} = 0 THEN []::BIGINT[] ELSE range(0, ceil(greatest({n} - {size}, 0) / {step}.0)::BIGINT * {step} + 1, {step}) END"


def chunk_ctes(size: int = 500, overlap: int = 100, text: str = "", name: str = "chunks_") -> str:
    body = text or clean("text")
    return f"""cleaned_{name} AS (SELECT * REPLACE ({body} AS text) FROM pages_),
    headed_{name} AS (SELECT * REPLACE ({heading('text', 'chapter')} AS text) FROM cleaned_{name}),
    headed2_{name} AS (SELECT * REPLACE ({heading('text', 'section')} AS text) FROM headed_{name}),
    words_{name} AS (SELECT *, {words('text')} AS ws FROM headed2_{name}),
    starts_{name} AS (SELECT *, unnest({starts('len(ws)', size, overlap)}) AS start_word FROM words_{name}),
    {name} AS (SELECT page_no, start_word // {size - overlap} + 1 AS chunk_no, start_word::INTEGER AS start_word,
        printf('%02d-%03d', page_no, start_word // {size - overlap} + 1) AS chunk_id, book, chapter, section, source_url,
        array_to_string(ws[start_word + 1 : start_word + {size}], ' ') AS text FROM starts_{name})"""


def _buckets(source: str, key: str, text: str) -> str:
    return f"""(SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS b, count(*) AS c
        FROM (SELECT {key}, unnest({words(text)}) AS t FROM {source}) GROUP BY ALL)"""


def hit_ctes(name: str = "chunks_", hits: str = "hits_", k: int = K, max_score: float | None = None) -> str:
    low = "" if max_score is None else f"WHERE score <= {max_score}"
    return f"""ct_{name} AS {_buckets(name, 'page_no, chunk_no', 'text')},
    cn_{name} AS (SELECT page_no, chunk_no, sqrt(sum(c * c)) AS n FROM ct_{name} GROUP BY ALL),
    qt_{name} AS {_buckets('benchmark', 'item_id', 'text')},
    qn_{name} AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM qt_{name} GROUP BY ALL),
    dot_{name} AS (SELECT item_id, page_no, chunk_no, sum(q.c * x.c) AS d FROM qt_{name} q JOIN ct_{name} x USING (b) GROUP BY ALL),
    pair_{name} AS (SELECT q.item_id AS query_id, x.page_no, x.chunk_no, round(greatest(2 - 2 * coalesce(d, 0) / (q.n * x.n), 0), 9) AS score
        FROM qn_{name} q CROSS JOIN cn_{name} x LEFT JOIN dot_{name} z ON z.item_id = q.item_id AND z.page_no = x.page_no AND z.chunk_no = x.chunk_no),
    {hits} AS (SELECT r.query_id, rank, round(score, 6) AS score, 'l2_distance' AS score_metric, false AS higher_is_better,
        round(greatest(-1, least(1, 1 - score * score / 2)), 6) AS cosine_similarity, round(1 - score / 2, 6) AS cosine_true,
        score <= {THRESHOLD} AS passes_threshold, x.* EXCLUDE (start_word)
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, page_no, chunk_no) AS rank FROM pair_{name} {low}) r
        JOIN {name} x USING (page_no, chunk_no) WHERE rank <= {k})"""


GOLD = """gold_ AS (SELECT b.item_id AS query_id, any_value(b.text) AS question,
    CASE WHEN min(d.doc_id) IS NULL THEN 'unanswerable' ELSE 'answerable' END AS type, min(d.doc_id)::VARCHAR AS expected_chapter
    FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)"""
