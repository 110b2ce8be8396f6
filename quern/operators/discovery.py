"""Which pages make up a collection: links, listings, the root, ordered distinct titles, crawl outcomes, page records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import html as H
from quern.functions import text as T
from quern.functions import urls as U


def ordered_distinct(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by ``order``."""
    first = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")


def ordered_union(parts: list[DataFrame], key: str, place: str) -> DataFrame:
    """Rows of several lists, one after another, each key at its first place: source_no, place and key."""
    out = None
    for k, part in enumerate(parts):
        one = part.select(F.lit(k).cast("long").alias("source_no"), place, key)
        out = one if out is None else out.unionByName(one)
    return ordered_distinct(out, key, ["source_no", place])


def page_links(pages: DataFrame, roots: tuple[H.Root, ...] | None = None) -> DataFrame:
    """The page's columns with link_no and href of each of its links."""
    return pages.select("*", F.posexplode(H.links(F.col("html"), roots)).alias("link_no", "href")).withColumn("link_no", F.col("link_no").cast("long")).drop("html")


def judge_links(links: DataFrame, page_path: str = U.PAGE_PATH) -> DataFrame:
    """Adds link_url, title and reason: why a link of a page (url, root) leads to none of the collection's pages, or null.

    Roots are in NFC."""
    rows = links.withColumn("link_url", U.canonical_url(F.col("href"), F.col("url")))
    rows = rows.withColumn("title", U.title_from_url(F.col("link_url"), page_path))
    # Titles of URLs are in NFC; a root is one of them, or a setting.
    outside = F.col("title").isNull() | ~U.belongs_to(F.col("title"), F.col("root"), normal=True)
    reason = (
        F.when(~U.host_allowed(F.col("link_url"), F.col("url")), "off-site")
        .otherwise(F.coalesce(U.skip_reason(F.col("title"), F.col("href")), F.when(outside, "outside hierarchy")))
    )
    return rows.withColumn("reason", reason)


def toc_titles(judged: DataFrame, page: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(page, link_no, title) in document order without repeats or the root itself, and (page, skipped) counts."""
    fits = judged.where(F.col("reason").isNull() & (F.col("title") != F.col("root")))
    first = Window.partitionBy(page, "title").orderBy("link_no")
    titles = fits.withColumn("n_", F.row_number().over(first)).where("n_ = 1").select(page, "link_no", "title")
    return titles, judged.groupBy(page).agg(F.count_if(F.col("reason").isNotNull()).alias("skipped"))


def choose_root(titles: DataFrame, configured: str) -> DataFrame:
    """One row, root: the configured title if it is listed or has children, else the best root.

    Children lie below their first step, so that step is the key of an equi-join: no pairs of titles are compared.
    """
    name = titles.select(T.nfc(F.col("title")).alias("title")).distinct()
    is_child = F.col("title").contains("/")
    count = name.where(is_child).groupBy(F.substring_index("title", "/", 1).alias("root")).agg(F.count("*").alias("children"))
    roots = name.where(~is_child).select(F.col("title").alias("root")).join(count, "root", "left").select("root", F.coalesce("children", F.lit(0)).alias("children"))
    wanted = T.nfc(F.lit(configured))
    mine = name.select(F.max((F.col("title") == wanted) & ~is_child | F.col("title").startswith(F.concat(wanted, F.lit("/")))).alias("mine"))
    ranked = roots.select("root", (~F.col("root").startswith(F.concat(wanted, F.lit(" ")))).alias("other"), -F.col("children"), F.char_length("root")).toDF("root", "other", "fewer", "length")
    best = ranked.agg(F.min(F.struct("other", "fewer", "length", "root")).alias("best"))
    return mine.join(F.broadcast(best)).select(F.when(F.coalesce("mine", F.lit(False)) | F.col("best").isNull(), wanted).otherwise(F.col("best.root")).alias("root"))


def outcomes(pages: DataFrame) -> DataFrame:
    """Adds outcome to fetched pages (status, missing, title, root, text): page, failed fetch, http, missing, outside, empty.

    Titles and roots are in NFC, as ``title_from_url`` gives them."""
    failed = F.col("status").isNull()
    outcome = (
        F.when(failed, "fetch failed")
        .when(F.col("status") >= 400, "http error")
        .when(F.col("missing"), "missing")
        .when(~U.belongs_to(F.coalesce("title", F.lit("")), F.col("root"), normal=True), "outside")
        .when(F.col("text") == "", "empty")
        .otherwise("page")
    )
    return pages.withColumn("outcome", outcome)


def records(pages: DataFrame, book: str | Column) -> DataFrame:
    """Page records of judged pages: those with outcome ``page``."""
    chapter, section = U.chapter_and_section(F.col("title"), F.col("root"))
    return pages.where("outcome = 'page'").select(
        "page_no",
        (F.lit(book) if isinstance(book, str) else book).alias("book"),
        chapter.alias("chapter"),
        section.alias("section"),
        F.col("url").alias("source_url"),
        "title",
        "text",
        F.char_length("text").alias("char_count"),
    )


def summary(records_: DataFrame) -> DataFrame:
    """Pages, characters, first and last chapter."""
    return records_.agg(
        F.count("*").alias("pages"),
        F.sum(F.col("char_count").cast("long")).alias("chars"),
        F.min_by("chapter", "page_no").alias("first_chapter"),
        F.max_by("chapter", "page_no").alias("last_chapter"),
    )


def listed_titles(listings: DataFrame, page_path: str = U.PAGE_PATH) -> DataFrame:
    """listing_no, link_no, title of prefix listings (listing_no, url, html), first occurrences, in order."""
    links = page_links(listings, (("ul.mw-prefixindex-list",),))
    rows = links.withColumn("link_url", U.canonical_url(F.col("href"), F.col("url")))
    rows = rows.withColumn("title", U.title_from_url(F.col("link_url"), page_path))
    kept = rows.where(F.col("title").isNotNull() & U.skip_reason(F.col("title"), F.col("link_url")).isNull())
    return ordered_distinct(kept.select("listing_no", "link_no", "title"), "title", ["listing_no", "link_no"])
