"""Pages to overlapping windows of words. Pages are numbered by a column, so an empty page uses up its number too."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from quern.config import SETTINGS
from quern.functions import text as T
from quern.operators import embedding


def validate(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"the window must hold at least one word, not {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"the overlap must be at least 0 and under {size}, not {overlap}")


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts 0, step, 2 step ... up to the first window that reaches the end; none for no words."""
    step = size - overlap
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int") * step
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def chunk_id(page_no: Column, chunk_no: Column) -> Column:
    return F.format_string("%02d-%03d", page_no, chunk_no)


def windows(pages: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap, text: str = "text", prepared: bool = False) -> DataFrame:
    """page_no, chunk_no, start_word, chunk_id, book, chapter, section, source_url and text of each window of ``pages``.

    Of pages that are ``prepared`` a window has its words' buckets, too."""
    validate(size, overlap)
    rows = pages.withColumn("words_", T.words_of(F.col(text)) if prepared else T.words(F.col(text)))

    def window(start: Column) -> Column:
        told = F.array_join(F.slice("words_", start + 1, size), " ").alias("text")
        return F.struct(start.alias("start_word"), told, *([embedding.buckets_slice(F.col("buckets"), start, size).alias("buckets")] if prepared else []))

    meta = [T.or_default(F.col(c)).alias(c) for c in ("chapter", "section", "source_url")]
    rows = rows.select(
        "page_no",
        T.or_default(F.col("book"), SETTINGS.book_title).alias("book"),
        *meta,
        # Windows are cut before they are rows, so that none carries its whole page on.
        F.posexplode(F.transform(window_starts(F.size("words_"), size, overlap), window)).alias("at", "window_"),
    )
    number = (F.col("at") + 1).cast("long")
    return rows.select(
        "page_no",
        number.alias("chunk_no"),
        "window_.start_word",
        chunk_id(F.col("page_no"), number).alias("chunk_id"),
        "book",
        "chapter",
        "section",
        "source_url",
        "window_.text",
        *(["window_.buckets"] if prepared else []),
    )


@F.pandas_udf(StructType().add("text", StringType()).add("buckets", BinaryType()))
def _prepared(texts: pd.Series, headings: pd.Series) -> pd.DataFrame:
    words = [T.without_headings(t, h).split() for t, h in zip(texts, headings, strict=True)]
    return pd.DataFrame({"text": map(" ".join, words), "buckets": map(embedding.word_buckets, words)}, dtype=object)


def prepared(pages: DataFrame) -> DataFrame:
    """Pages with their clean texts' words, a space between two, and these words' buckets: what takes longest is done once for windows of any size."""
    told = _prepared(T.clean(F.col("text")), F.array("chapter", "section"))
    return pages.withColumn("told_", told).withColumns({"text": F.col("told_.text"), "buckets": F.col("told_.buckets")}).drop("told_")


def chunk_pages(pages: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """Clean, drop headings that repeat chapter and section, and cut into windows; page by page, without a shuffle."""
    rows = pages.withColumn("clean_", T.strip_headings(T.clean(F.col("text")), F.col("chapter"), F.col("section")))
    return windows(rows, size, overlap, text="clean_")


def nonempty(chunks: DataFrame) -> DataFrame:
    """Chunks with any text; raising on none is the writer's part (sources.index)."""
    return chunks.where(T.strip(F.coalesce(F.col("text"), F.lit(""))) != "")
