"""A collection from the web: what its pages are, their landing, and their records as a DataFrame.

Fetching is polite, so a host is asked one page at a time. Discovery follows links, so the driver asks for its pages; the collection's
pages are landed by a source that asks hosts side by side. All of it goes through a frontier, a written table, and
everything after that is a plan over it.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import SETTINGS
from quern.functions import html as H
from quern.functions import urls as U
from quern.operators import discovery
from quern.shared import fresh_path, materialize
from quern.shipping import ship
from quern.sources import frontier, landing, web

Fetch = Callable[[str], landing.Reply]
BATCH = frontier.BATCH


def _origin(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}"


def page_url(origin: str, title: str) -> str:
    return f"{origin}{U.PAGE_PATH}{title.replace(' ', '_')}"


def listed(spark: SparkSession, url: str, prefix: str, fetch: Fetch) -> DataFrame:
    """listing_no, link_no, title of the listing of titles that begin so."""
    first = spark.createDataFrame([(url, prefix)], "u string, p string").select(U.prefix_listing_url(F.col("u"), F.col("p"))).first()[0]
    replies = landing.listing_pages(first, fetch, landing.next_link)
    rows = [(k, final, html) for k, (final, html, _) in enumerate(replies)]
    return discovery.listed_titles(spark.createDataFrame(rows, "listing_no long, url string, html string"))


def discover(spark: SparkSession, url: str, fetch: Fetch, title: str = SETTINGS.book_title) -> tuple[str, list[str]]:
    """The root title and the URLs of its pages: its contents in order, then what only listings know.

    A start that is missing is looked up by its title; one that redirects, by both titles. No pages is an error: the
    root alone is never taken for a collection.
    """
    ship(spark)
    configured = U.page_title(url) or title
    final, html, status = fetch(url)
    found = [listed(spark, url, configured, fetch)]
    if status < 400 and not H.read_page(html).missing:
        moved = U.page_title(final)
        if moved and moved != configured:
            found.append(listed(spark, final, moved, fetch))
    place = F.struct("listing_no", "link_no").alias("place")
    titles = discovery.ordered_union([f.select(place, "title") for f in found], "title", "place")
    root = discovery.choose_root(titles, configured).first()["root"]
    if root != configured:
        found.append(listed(spark, url, root + "/", fetch))
    origin = _origin(url)
    root_url, root_html, status = fetch(page_url(origin, root))
    lists = [f.select(place, "title") for f in found]
    if status < 400 and not H.read_page(root_html).missing:
        page = spark.createDataFrame([(0, root_url, root_html, root)], "page_id long, url string, html string, root string")
        toc, _ = discovery.toc_titles(discovery.judge_links(discovery.page_links(page, (("#mw-content-text",),))))
        lists.insert(0, toc.select(F.struct(F.col("page_id").alias("listing_no"), "link_no").alias("place"), "title"))
    every = discovery.ordered_union(lists, "title", "place")
    mine = every.where(U.belongs_to(F.col("title"), F.lit(root)) & (F.col("title") != root)).orderBy("source_no", "place")
    # One collection's titles: as many as will be fetched one by one.
    urls = [page_url(origin, r["title"]) for r in mine.select("title").collect()]
    if not urls:
        raise RuntimeError(f"{url} leads to no pages below {root}")
    return root, urls


def landed(spark: SparkSession, urls: list[str], fetch: Fetch | None = None, where: str | None = None) -> DataFrame:
    """page_no, asked, url (the final one), status (null if fetching failed) and html of each URL.

    The URLs are a frontier below ``where``, advanced in rounds of BATCH: with ``fetch`` by the driver, else by the source of web pages, hosts
    side by side. Begun again with the same folder, it fetches only what has not landed; pages that could not be fetched are tried again.
    """
    held = frontier.Frontier(spark, where or fresh_path(spark, "frontier"))
    held.add(urls, "contents")
    held.advance(frontier.by_driver(spark, fetch) if fetch else lambda some: web.pages(spark, some).select("asked", "url", "status", "html"), BATCH, urls)
    # The list of URLs is what was asked for one by one, so it is small; page numbers are places in it.
    places = spark.createDataFrame(list(dict((u, k + 1) for k, u in reversed(list(enumerate(urls)))).items()), "asked string, page_no long")
    return held.states().join(F.broadcast(places), "asked").select("page_no", "asked", "url", "status", "html")


def land(spark: SparkSession, urls: list[str], fetch: Fetch | None = None, where: str | None = None) -> DataFrame:
    """``landed`` without what was asked for."""
    return landed(spark, urls, fetch, where).drop("asked")


def judged(pages: DataFrame, root: str) -> DataFrame:
    """Landed pages with their outcome, title and text. A final URL that names no title leaves the page the title that was asked for."""
    ship(pages.sparkSession)
    title = F.coalesce(U.title_from_url(F.col("url")), U.title_from_url(F.col("asked")))
    rows = pages.select("page_no", "url", "status", H.content(F.col("html")).alias("page"), title.alias("title"), F.lit(root).alias("root"))
    return discovery.outcomes(rows.select("page_no", "url", "status", "page.missing", "title", "page.text", "root"))


def crawl(
    spark: SparkSession, url: str = SETTINGS.book_url, fetch: Fetch | None = None, book: str = SETTINGS.book_title, where: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Page records of a collection, and pages by outcome. ``where`` keeps the frontier: a later run with it goes on where this one ended."""
    where = where or fresh_path(spark, "frontier")
    held = frontier.Frontier(spark, where)
    with landing.Session() as session:
        pace = landing.Pace()
        one = fetch or (lambda u: landing.fetch(u, pace, allow_error=True, get=session.get))
        _, urls = discover(spark, url, lambda u: held.ask(u, one), book)
    # The root of the first page's title: below a root with a slash, that is its first step.
    root = (U.page_title(urls[0]) or book).partition("/")[0]
    pages = materialize(spark, judged(landed(spark, urls, fetch, where), root), "judged")
    return discovery.records(pages, book), pages.groupBy("outcome").agg(F.count("*").alias("pages"))
