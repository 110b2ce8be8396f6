"""HTML: text of the content root, links, markers. An event parser with a stack, tolerant of unclosed tags."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

Root = tuple[str, ...]
#: Content roots, the best first; each is a path of simple selectors (fixed values).
ROOTS: tuple[Root, ...] = (("#mw-content-text", ".mw-parser-output"), ("#mw-content-text",))
MISSING = "noarticletext"
#: What is cut out of the content (fixed values).
UNWANTED = (
    "script", "style", "noscript", "iframe", ".mw-editsection", ".mw-editsection-like", "sup.reference", "ol.references",
    "div.references", "#references", "nav", ".navbox", ".navbar", "#toc", ".toc", ".mw-indicators", ".ws-noexport",
    ".headertemplate", ".footertemplate", ".wikisource-header-template", ".noprint", ".printfooter", ".mw-empty-elt",
    "table.pr_quality", ".pr_quality", "span.pagenum", ".ws-pagenum", "figure", ".thumb", ".mw-file-description", "table",
)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open paragraph.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = frozenset("li dt dd tr td th option".split())
_BREAKS = re.compile("\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")


@dataclass
class _Node:
    tag: str
    ids: str
    classes: frozenset[str]
    cut: bool
    open_roots: tuple[int, ...]


@dataclass
class Page:
    """What a page holds: pieces of text by root, links (all, and by root), and whether a missing marker stands in it."""

    texts: dict[int, list[str]] = field(default_factory=dict)
    links: list[tuple[str, tuple[int, ...], frozenset[str]]] = field(default_factory=list)
    missing: bool = False
    missing_in: set[int] = field(default_factory=set)


def _matches(selector: str, tag: str, ids: str, classes: frozenset[str]) -> bool:
    name, mark, value = re.fullmatch(r"([a-z0-9]*)([#.]?)(.*)", selector).groups()
    return (not name or name == tag) and (not mark or (ids == value if mark == "#" else value in classes))


class _Reader(HTMLParser):
    def __init__(self, roots: tuple[Root, ...], unwanted: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.roots, self.unwanted = roots, unwanted
        self.stack: list[_Node] = []
        self.page = Page()

    def _close(self, tag: str, barrier: frozenset[str] = frozenset()) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in barrier:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._close("p", frozenset(("table", "td", "th")))
        if tag in _SAME:
            self._close(tag, frozenset(("ul", "ol", "dl", "table", "select")))
        given = {k: v or "" for k, v in reversed(attrs)}
        ids, classes = given.get("id", ""), frozenset(given.get("class", "").split())
        above = self.stack[-1] if self.stack else None
        roots = above.open_roots if above else ()
        for k, path in enumerate(self.roots):
            if k not in self.page.texts and _matches(path[-1], tag, ids, classes):
                chain = iter(self.stack)
                if all(any(_matches(s, n.tag, n.ids, n.classes) for n in chain) for s in path[:-1]):
                    self.page.texts[k] = []
                    roots = (*roots, k)
        if MISSING in classes:
            self.page.missing = True
            self.page.missing_in.update(above.open_roots if above else ())
        if tag == "a" and given.get("href"):
            self.page.links.append((given["href"], roots, classes | ({"rel-next"} if given.get("rel") == "next" else set())))
        cut = bool(above and above.cut) or any(_matches(s, tag, ids, classes) for s in self.unwanted)
        if tag not in _VOID:
            self.stack.append(_Node(tag, ids, classes, cut, roots))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if self.stack and not self.stack[-1].cut and (bare := data.strip()):
            for k in self.stack[-1].open_roots:
                self.page.texts[k].append(bare)


def read_page(html: str | None, roots: tuple[Root, ...] = ROOTS, unwanted: tuple[str, ...] = UNWANTED) -> Page:
    reader = _Reader(roots, unwanted)
    reader.feed(html or "")
    reader.close()
    return reader.page


def main_text(html: str | None, roots: tuple[Root, ...] = ROOTS, unwanted: tuple[str, ...] = UNWANTED) -> str:
    """Text of the best root that the page has, a line for each piece; empty without root or with a missing marker."""
    return text_of(read_page(html, roots, unwanted), roots)


def text_of(page: Page, roots: tuple[Root, ...]) -> str:
    best = next((k for k in range(len(roots)) if k in page.texts), None)
    if best is None or best in page.missing_in:
        return ""
    text = unicodedata.normalize("NFC", "\n".join(page.texts[best])).replace("\ufeff", "").replace("\u200b", "")
    kept = (re.sub(r"[ \t]+", " ", line).strip() for line in _BREAKS.split(text))
    return "\n".join(line for line in kept if line)


def extract_text(column: Column, roots: tuple[Root, ...] = ROOTS, unwanted: tuple[str, ...] = UNWANTED) -> Column:
    @F.pandas_udf(StringType())
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield s.map(lambda h: main_text(h, roots, unwanted))

    return run(column)


def links(column: Column, roots: tuple[Root, ...] | None = None) -> Column:
    """hrefs in document order: of the whole page, or inside the last of ``roots``."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield s.map(lambda h: [x for x, at, _ in read_page(h, roots or ROOTS).links if roots is None or len(roots) - 1 in at])

    return run(column)


def content(column: Column, roots: tuple[Root, ...] = ROOTS, unwanted: tuple[str, ...] = UNWANTED) -> Column:
    """text, missing: what ``extract_text`` and ``is_missing`` give, from reading each page once."""

    @F.pandas_udf("text string, missing boolean")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in pages:
            read = [read_page(h, roots, unwanted) for h in s]
            yield pd.DataFrame({"text": [text_of(p, roots) for p in read], "missing": [p.missing for p in read]})

    # Else a filter on what it tells would be pushed down, with a reading of every page for itself, before the pages are spread.
    return run.asNondeterministic()(column)


def is_missing(column: Column) -> Column:
    @F.pandas_udf(BooleanType())
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield s.map(lambda h: read_page(h).missing)

    return run(column)
