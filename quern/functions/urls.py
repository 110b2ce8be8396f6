"""URLs: titles, canonical form, hosts, reasons to skip, place in a hierarchy."""

from __future__ import annotations

import unicodedata
from urllib.parse import parse_qs, quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Title prefixes of pages that are never prose (fixed values).
SKIPPED_NAMESPACES = (
    "বিশেষ:", "Special:", "পাতা:", "Page:", "নির্ঘণ্ট:", "Index:", "চিত্র:", "File:", "Image:", "Media:", "টেমপ্লেট:", "Template:",
    "বিষয়শ্রেণী:", "Category:", "সাহায্য:", "Help:", "উইকিসংকলন:", "Wikisource:", "লেখক:", "Author:", "রচনা:", "আলাপ:", "Talk:",
    "ব্যবহারকারী:", "User:", "মডিউল:", "Module:", "মিডিয়াউইকি:", "MediaWiki:", "প্রবেশদ্বার:", "Portal:",
)

PAGE_PATH = "/wiki/"


def _path(url: str) -> str:
    """A URL's path without the parameters of its last segment."""
    whole = urlsplit(url).path
    head, slash, last = whole.rpartition("/")
    return head + slash + last.partition(";")[0]


def page_title(url: str | None, page_path: str = PAGE_PATH) -> str | None:
    """The title that a URL names by path or by its ``title`` parameter."""
    try:
        path = unquote(_path(url or ""))
        named = path.removeprefix(page_path) if path.startswith(page_path) else None
        if named is None:
            named = unquote(next(iter(parse_qs(urlsplit(url or "").query).get("title", ())), ""))
    except ValueError:
        return None
    return unicodedata.normalize("NFC", named.replace("_", " ").strip()) or None


def canonical(url: str | None, base: str | None) -> str:
    """Absolute, path decoded, without query and fragment; parameters of the last segment stay."""
    try:
        whole = urljoin(base or "", (url or "").strip())
        parts = urlsplit(whole)
    except ValueError:
        return url or ""
    own = _path(whole)
    tail = parts.path[len(own) :]
    return parts._replace(path=unquote(own) + tail, query="", fragment="").geturl()


def title_from_url(column: Column, page_path: str = PAGE_PATH) -> Column:
    @F.pandas_udf(StringType())
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: page_title(u, page_path))

    return run(column)


@F.pandas_udf(StringType())
def canonical_url(urls: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([canonical(u, b) for u, b in zip(urls, bases, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def unquoted(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else unquote(u))


@F.pandas_udf(StringType())
def quoted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: quote(t or ""))


def authority(column: Column) -> Column:
    return F.lower(F.regexp_extract(column, "^[^:/?#]+://([^/?#]*)", 1))


def host_allowed(url: Column, base: Column) -> Column:
    """Same host, not counting leading letters w and dots."""
    mine, theirs = (F.ltrim(authority(F.coalesce(c, F.lit(""))), F.lit("w.")) for c in (url, base))
    return (mine != "") & (mine == theirs)


def skip_reason(title: Column, url: Column) -> Column:
    """Why a page isn't prose, or null; the first reason that holds."""
    low = F.lower(F.coalesce(url, F.lit("")))
    out = F.when(low.contains("action=edit") | low.contains("redlink=1"), "edit/redlink").when(title.isNull(), "not a wiki title")
    out = out.when(title.startswith(SKIPPED_NAMESPACES[0]) | F.lower(title).startswith("special:"), "special page")
    for prefix in SKIPPED_NAMESPACES:
        out = out.when(title.startswith(prefix), f"namespace {prefix[:-1]}")
    return out


def belongs_to(title: Column, root: Column, normal: bool = False) -> Column:
    """The root itself or below it; both are taken in NFC, in which titles from URLs are already (``normal``)."""
    from quern.functions.text import nfc

    t, r = (title, root) if normal else (nfc(title), nfc(root))
    return (t == r) | t.startswith(F.concat(r, F.lit("/")))


def chapter_and_section(title: Column, root: Column) -> tuple[Column, Column]:
    """First step below the root, and the rest joined by slashes."""
    rest = F.when(title.startswith(root), F.regexp_replace(F.substr(title, F.char_length(root) + 1), "^/+", "")).otherwise(title)
    parts = F.filter(F.split(rest, "/"), lambda p: p != "")
    chapter = F.when(title == root, root).otherwise(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")))
    section = F.when(title == root, "").otherwise(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "/"))
    return chapter, section


def prefix_listing_url(base: Column, prefix: Column) -> Column:
    origin = F.regexp_extract(base, "^([^:/?#]+://[^/?#]*)", 1)
    return F.concat(origin, F.lit("/w/index.php?title=Special:PrefixIndex&namespace=0&prefix="), quoted(prefix))
