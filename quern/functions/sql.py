"""The library's functions in SQL text: ``register`` puts them into a session, for ``spark.sql``.

What SQL can express are SQL functions, so Catalyst inlines them, and their plans have no Python, and no join or shuffle of their own:

    text_words(text), window_starts(n, size, overlap), chunk_id(page_no, chunk_no), e5_prefix(text, prefix), l2_to_cosine(score),
    passes_threshold(score, threshold), host_allowed(url, base)
    SELECT page_no, w.* FROM (SELECT page_no, word_windows(text, 500, 100) AS ws FROM pages)
        LATERAL VIEW OUTER inline(ws) w WHERE chunk_no IS NOT NULL               -- chunk_no, start_word, text

(``word_windows`` is an array on purpose: a SQL table function with LATERAL would be joined back to its table by the text. OUTER keeps
Spark from asking first whether the array has anything, which would make all of it once more, and cut the words again for each window.)

Those that need Python are the library's own functions of columns, and a table function of a whole table:

    nfc(text), title_from_url(url), canonical_url(url, base), extract_text(html)
    SELECT * FROM page_links(TABLE(SELECT page_id, url, html FROM pages))        -- page_id, url, link_no, href
    SELECT * FROM chunk_words(TABLE(SELECT page_no, text FROM pages), 500, 100)  -- the table's columns but text, chunk_no, start_word, text

Names are the session's own and temporary. Windows that make no sense (size under 1, overlap under 0 or not under the size) are errors, as in
``chunking.validate``. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quern.functions import html, text, urls
from quern.shipping import ship

#: White space as SQL text has it, where backslashes are doubled once more.
_WS = text.WS.replace("\\", "\\\\") + "+"
_BLANK = "".join(f"\\u{ord(c):04x}" for c in text.WS_CHARACTERS)
_STRIPPED = f"btrim(coalesce(t, ''), '{_BLANK}')"
_HOST = "trim(LEADING 'w.' FROM lower(regexp_extract(coalesce({}, ''), '^[^:/?#]+://([^/?#]*)', 1)))"
_BAD = "size < 1 OR overlap < 0 OR overlap >= size"

SCALARS = (
    f"text_words(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(coalesce(t, ''), '{_WS}'), w -> w <> '')",
    f"""window_starts(n INT, size INT, overlap INT) RETURNS ARRAY<INT> RETURN CASE
        WHEN {_BAD} THEN raise_error('the window must hold a word, and more than its overlap')
        WHEN n > 0 THEN sequence(0, CAST(ceil(greatest(n - size, 0) / (size - overlap)) AS INT) * (size - overlap), size - overlap)
        ELSE CAST(array() AS ARRAY<INT>) END""",
    "chunk_id(page_no BIGINT, chunk_no BIGINT) RETURNS STRING RETURN format_string('%02d-%03d', page_no, chunk_no)",
    f"""e5_prefix(t STRING, prefix STRING) RETURNS STRING RETURN CASE
        WHEN startswith({_STRIPPED}, 'query:') OR startswith({_STRIPPED}, 'passage:') THEN {_STRIPPED} ELSE prefix || {_STRIPPED} END""",
    "l2_to_cosine(score DOUBLE) RETURNS DOUBLE RETURN greatest(-1D, least(1D, 1 - pow(score, 2) / 2))",
    "passes_threshold(score DOUBLE, threshold DOUBLE) RETURNS BOOLEAN RETURN score <= threshold",
    f"""host_allowed(url STRING, base STRING) RETURNS BOOLEAN RETURN {_HOST.format('url')} <> '' AND {_HOST.format('url')} = {_HOST.format('base')}""",
    """windows_of(ws ARRAY<STRING>, size INT, overlap INT) RETURNS ARRAY<STRUCT<chunk_no: BIGINT, start_word: INT, text: STRING>> RETURN
        transform(window_starts(size(ws), size, overlap), (s, i) -> named_struct('chunk_no', CAST(i + 1 AS BIGINT), 'start_word', s, 'text', array_join(slice(ws, s + 1, size), ' ')))""",
    # By way of another function, whose argument is evaluated once and not once a window.
    """word_windows(t STRING, size INT, overlap INT) RETURNS ARRAY<STRUCT<chunk_no: BIGINT, start_word: INT, text: STRING>> RETURN windows_of(text_words(t), size, overlap)""",
)


class PageLinks:
    """Links of each page (page_id, url, html) in document order."""

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or [f.name for f in pages.dataType] != ["page_id", "url", "html"]:
            raise ValueError("page_links takes a table of page_id, url and html")
        schema = StructType().add("page_id", pages.dataType["page_id"].dataType).add("url", StringType()).add("link_no", LongType()).add("href", StringType())
        return AnalyzeResult(schema)

    def eval(self, page: Row) -> Iterator[tuple]:
        for k, (href, _, _) in enumerate(html.read_page(page["html"] or "").links):
            yield page["page_id"], page["url"], k, href


class ChunkWords:
    """Windows of words of each row's ``text``; the row's other columns go with them."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        from quern.operators.chunking import validate

        if not rows.isTable or "text" not in [f.name for f in rows.dataType]:
            raise ValueError("chunk_words takes a table with a column text")
        validate(size.value, overlap.value)
        schema = StructType([f for f in rows.dataType if f.name != "text"])
        return AnalyzeResult(schema.add("chunk_no", LongType()).add("start_word", IntegerType()).add("text", StringType()))

    def eval(self, row: Row, size: int, overlap: int) -> Iterator[tuple]:
        words, step = (row["text"] or "").split(), size - overlap
        rest = tuple(v for k, v in row.asDict().items() if k != "text")
        windows = 1 + -(-max(len(words) - size, 0) // step) if words else 0
        for k in range(windows):
            yield (*rest, k + 1, k * step, " ".join(words[k * step : k * step + size]))


@F.pandas_udf(StringType())
def _title(addresses: pd.Series) -> pd.Series:
    return addresses.map(urls.page_title)


@F.pandas_udf(StringType())
def _text(pages: pd.Series) -> pd.Series:
    return pages.map(html.main_text)


def register(spark: SparkSession) -> None:
    """All functions, under their names, in this session; again is as once."""
    ship(spark)
    for body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    spark.udf.register("nfc", text._nfc)
    spark.udf.register("canonical_url", urls.canonical_url)
    spark.udf.register("title_from_url", _title)
    spark.udf.register("extract_text", _text)
    spark.udtf.register("page_links", F.udtf(PageLinks))
    spark.udtf.register("chunk_words", F.udtf(ChunkWords))
