import json

import pytest

from quern import cli
from quern.sources import crawl


def site(pages, listings):
    """A fetch function over a small site: titles to bodies, prefixes to titles."""

    def fetch(url):
        if "PrefixIndex" in url:
            from urllib.parse import unquote

            prefix = unquote(url.partition("prefix=")[2])
            return url, "<ul class='mw-prefixindex-list'>" + "".join(f"<li><a href='/wiki/{t}'>x</a>" for t in listings.get(prefix, ())) + "</ul>", 200
        title = url.partition("/wiki/")[2]
        if title == "broken":
            raise RuntimeError("lost")
        to, body = pages.get(title, (title, None))
        if body is None:
            return url, "<p class=noarticletext>", 404
        return f"https://h.org/wiki/{to}", f"<div id=mw-content-text>{body}</div>", 200

    return fetch


def test_contents_come_first_then_listings(spark):
    pages = {"R": ("R", "<a href='/wiki/R/b'>b</a><a href='/wiki/R/a'>a</a><a href='/wiki/Talk:R'>t</a>"), "R/a": ("R/a", "text a"), "R/b": ("R/b", "text b"), "R/c": ("S", "moved")}
    fetch = site(pages, {"R": ["R", "R/a", "R/c", "R/d"]})
    root, urls = crawl.discover(spark, "https://h.org/wiki/R", fetch)
    assert root == "R" and [u.rpartition("/")[2] for u in urls] == ["b", "a", "c", "d"]
    records, outcomes = crawl.crawl(spark, "https://h.org/wiki/R", fetch, "Book")
    assert [(r["page_no"], r["chapter"], r["text"]) for r in records.orderBy("page_no").collect()] == [(1, "b", "text b"), (2, "a", "text a")]
    assert {r["outcome"]: r["pages"] for r in outcomes.collect()} == {"page": 2, "outside": 1, "http error": 1}


def test_missing_start_is_looked_up(spark):
    pages = {"R (1)": ("R (1)", ""), "R_(1)": ("R (1)", "")}
    fetch = site(pages, {"R": ["R (1)", "R (1)/a", "R (2)"], "R (1)/": ["R (1)/a", "R (1)/z"]})
    root, urls = crawl.discover(spark, "https://h.org/wiki/R", fetch)
    assert root == "R (1)" and [u.rpartition("/")[2] for u in urls] == ["a", "z"]


def test_a_root_alone_is_refused(spark):
    with pytest.raises(RuntimeError):
        crawl.discover(spark, "https://h.org/wiki/R", site({"R": ("R", "x")}, {"R": ["R"]}))


def test_commands(spark, tmp_path, capsys):
    rows = [{"book": "b", "chapter": "one", "section": "", "source_url": "u1", "text": "red fox runs"}, {"book": "b", "chapter": "two", "source_url": "u2", "text": "blue whale swims"}]
    (tmp_path / "pages.json").write_text(json.dumps(rows))
    (tmp_path / "q.json").write_text(json.dumps([{"question": "red fox runs", "expected_chapter": "one", "type": "answerable"}, {"question": "nothing", "type": "unanswerable"}]))
    where = f"file://{tmp_path}/index"
    cli.main(["build", f"{tmp_path}/pages.json", where], spark)
    cli.main(["ask", where, "red fox runs", "green"], spark)
    cli.main(["evaluate", f"{tmp_path}/q.json", where], spark)
    cli.main(["evaluate", f"{tmp_path}/q.json", where, "--compare", f"{tmp_path}/pages.json"], spark)
    said = capsys.readouterr().out
    assert "chunks: 2" in said and "red fox runs\n  one  u1" in said
    assert "[answerable] best 0.0000 gate PASS chapter HIT" in said and "hit rate: 1/1 = 100.00%" in said and "unanswerable gated: 1/1" in said
    assert "A 500-word chunks, 100-word overlap (production): 2 chunks, 1/1 = 100.00%" in said
