"""Citations and source records of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Shown where a hit has neither book nor chapter nor section (fixed values).
UNNAMED, UNKNOWN_CHAPTER, NOWHERE = "নির্বাচিত বই", "অজানা অধ্যায়", "—"


def _part(column: Column) -> Column:
    return F.nullif(T.strip(F.coalesce(column, F.lit(""))), F.lit(""))


def format_citation(book: Column, chapter: Column, section: Column, url: Column) -> Column:
    label = or_(F.concat_ws(", ", _part(book), _part(chapter), _part(section)), UNNAMED)
    return F.concat_ws(" — ", label, _part(url))


def or_(column: Column, default: str) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def location(chapter: Column, section: Column) -> Column:
    return or_(F.concat_ws(" / ", _part(chapter), _part(section)), NOWHERE)


def merged(top: Column, nested: Column) -> Column:
    """A field of a hit, or of its metadata, or empty."""
    return F.coalesce(F.nullif(top, F.lit("")), F.nullif(nested, F.lit("")), F.lit(""))


def source_records(hits: DataFrame) -> DataFrame:
    """query_id, position, book, chapter, section, source_url: the first hit of each chapter and URL, by rank."""
    first = Window.partitionBy("query_id", "chapter", "source_url").orderBy("rank")
    kept = hits.withColumn("n_", F.row_number().over(first)).where("n_ = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return kept.select("query_id", place.alias("position"), "book", "chapter", "section", "source_url")


def citations(hits: DataFrame) -> DataFrame:
    return source_records(hits).select(
        "query_id", "position", format_citation(*(F.col(c) for c in ("book", "chapter", "section", "source_url"))).alias("citation")
    )
