"""Landing from a real server on this machine: kept connections, hosts side by side, and crawls that go on where they ended."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quern.sources import crawl, frontier, landing, web


class Site:
    """A server that notes what it is asked, when, and over how many connections."""

    def __init__(self, pages):
        self.pages, self.asked, self.agents, self.connections = pages, [], set(), 0
        site = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def setup(self):
                site.connections += 1
                super().setup()

            def do_GET(self):
                site.asked.append((self.path, time.monotonic()))
                site.agents.add(self.headers["User-Agent"])
                status, headers, body = site.reply(self.path)
                if status == 0:  # the connection breaks
                    self.close_connection = True
                    return
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)
                self.close_connection = headers.get("Connection") == "close"

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.at = f"http://127.0.0.1:{self.server.server_port}"

    def reply(self, path):
        found = self.pages.get(path, (404, {}, b"none"))
        if isinstance(found, list):
            found = found.pop(0) if len(found) > 1 else found[0]
        return found if isinstance(found, tuple) else (200, {"Content-Type": "text/html; charset=utf-8"}, found.encode())


@pytest.fixture
def site():
    made = []

    def start(pages):
        made.append(Site(pages))
        return made[-1]

    yield start
    for s in made:
        s.server.shutdown()
        s.server.server_close()


def test_a_session_keeps_its_connection_and_follows_redirects(site):
    s = site({"/a": "one", "/b": (302, {"Location": "/a"}, b""), "/c": (200, {"Connection": "close"}, b"closes"), "/e": (503, {}, b"busy"), "/loop": (301, {"Location": "/loop"}, b"")})
    with landing.Session() as session:
        assert session.get(s.at + "/a") == (s.at + "/a", "one", 200)
        assert session.get(s.at + "/b") == (s.at + "/a", "one", 200)
        assert session.get(s.at + "/e")[2] == 503 and s.connections == 1
        assert session.get(s.at + "/c")[1] == "closes" and session.get(s.at + "/a")[1] == "one"
        assert s.connections == 2 and s.agents == {landing.AGENT}
        with pytest.raises(OSError, match="redirects"):
            session.get(s.at + "/loop")
        for bad in ("ftp://x/y", "no address", "http://127.0.0.1:1/"):
            with pytest.raises(OSError):
                session.get(bad)


def test_letters_that_urls_cannot_hold_and_charsets(site):
    latin = '<meta charset="windows-1252">é€'.encode("cp1252")
    s = site({"/wiki/%E0%A6%B0_(1)?q=%C3%A9": "found", "/latin": (200, {}, latin), "/plain": (200, {}, "é".encode()), "/odd": (200, {"Content-Type": "text/html; charset=nonsense"}, b"\xe9")})
    assert landing.get(s.at + "/wiki/র_(1)?q=é")[1] == "found"
    assert [landing.get(s.at + p)[1] for p in ("/latin", "/plain", "/odd")] == ['<meta charset="windows-1252">é€', "é", "é"]


def test_two_hosts_land_side_by_side_each_at_its_pace(spark, site):
    one, two = site({f"/{k}": f"one {k}" for k in range(5)}), site({f"/{k}": f"two {k}" for k in range(5)})
    urls = [s.at + f"/{k}" for k in range(5) for s in (one, two)] + [one.at + "/0", one.at + "/none", "nonsense"]
    df = web.pages(spark, urls, delay=0.8, attempts=1)
    assert df.rdd.getNumPartitions() == 3
    one.asked.clear()
    rows = sorted(df.collect())
    assert [(r["position"], r["asked"]) for r in rows] == [(k, u) for k, u in enumerate(urls) if k != 10]
    assert [r["html"] for r in rows[:4]] == ["one 0", "two 0", "one 1", "two 1"] and [r["status"] for r in rows[-2:]] == [404, None]
    for s, n in ((one, 6), (two, 5)):
        times = [t for _, t in s.asked]
        assert len(times) == n and all(b - a >= 0.78 for a, b in zip(times, times[1:]))
        assert s.connections == 1
    spans = [(s.asked[0][1], s.asked[-1][1]) for s in (one, two)]
    assert max(a for a, _ in spans) < min(b for _, b in spans)  # neither waits for the other to end


def test_a_host_that_is_busy_or_breaks_is_asked_again(spark, site):
    s = site({"/busy": [(503, {}, b""), "at last"], "/breaks": [(0, {}, b""), (0, {}, b""), "whole"], "/down": (500, {}, b"down")})
    rows = {r["asked"].rpartition("/")[2]: (r["status"], r["html"]) for r in web.pages(spark, [s.at + p for p in ("/busy", "/breaks", "/down")], delay=0.01).collect()}
    assert rows == {"busy": (200, "at last"), "breaks": (200, "whole"), "down": (500, "down")}


def test_no_urls_and_what_is_no_list(spark):
    assert web.pages(spark, []).collect() == []
    spark.dataSource.register(web.WebPages)
    with pytest.raises(Exception, match="JSON array"):
        spark.read.format("web_pages").option("urls", json.dumps({"a": 1})).load().collect()


def test_states_of_a_frontier(spark, tmp_path):
    ticks = iter(range(1, 1000))
    held = frontier.Frontier(spark, f"file://{tmp_path}/f", clock=lambda: next(ticks))
    assert held.due() == [] and held.states().collect() == []
    held.add(["a", "b", "a", "c"], "contents")
    held.add(["c", "d"], "listing")
    assert held.due() == ["a", "b", "c", "d"] and held.due(2) == ["a", "b"] and held.due(9, ["d", "x"]) == ["d"]
    held.record(spark.createDataFrame([("a", "a2", 200, "A"), ("b", "b", None, None), ("c", "c", 404, "")], frontier.REPLIES))
    assert held.due() == ["d", "b"]
    held.record(spark.createDataFrame([("b", "b", None, None)], frontier.REPLIES))
    assert held.due() == ["d"]
    got = {r["asked"]: (r["found_by"], r["place"], r["state"], r["tries"], r["url"]) for r in held.states().collect()}
    assert got == {"a": ("contents", 1, "landed", 0, "a2"), "b": ("contents", 2, "failed", 2, "b"), "c": ("contents", 3, "landed", 0, "c"), "d": ("listing", 5, "new", 0, None)}
    assert frontier.Frontier(spark, f"file://{tmp_path}/f").due() == ["b", "d"]  # a new run has attempts of its own


def wiki(broken=()):
    """A small collection: contents, a listing of two pages, a page that is moved to an address without a title."""
    def listing(titles, more=""):
        return "<ul class='mw-prefixindex-list'>" + "".join(f"<li><a href='/wiki/{t}'>x</a>" for t in titles) + "</ul>" + more

    body = lambda t: f"<div id=mw-content-text>{t}</div>"
    index = "/w/index.php?title=Special:PrefixIndex&namespace=0&prefix=R"
    pages = {
        "/wiki/R": body("<a href='/wiki/R/b'>b</a><a href='/wiki/R/a'>a</a>"), index: listing(["R", "R/a"], "<a class='mw-nextlink' href='/w/index.php?next=2'>n</a>"),
        "/w/index.php?next=2": listing(["R/c", "R/d"]), "/wiki/R/a": body("text a"), "/wiki/R/b": (302, {"Location": "/w/index.php?curid=5"}, b""), "/w/index.php?curid=5": body("text b"),
        "/wiki/R/c": body("text c"), "/wiki/R/d": (500, {}, b"") if "d" in broken else body("text d"),
    }
    return pages


class Ended(BaseException):
    pass


@pytest.mark.parametrize("at", [1, 3, 6])
def test_a_crawl_that_ended_at_any_fetch_repeats_none(spark, site, tmp_path, monkeypatch, at):
    s = site(wiki())
    monkeypatch.setattr(crawl, "BATCH", 1)
    asked = []

    def fetch(url):
        if len(asked) == at and at not in ended:
            ended.add(at)
            raise Ended
        asked.append(url)
        return landing.fetch(url, landing.Pace(0), allow_error=True)

    ended, where = set(), f"file://{tmp_path}/frontier"
    with pytest.raises(Ended):
        crawl.crawl(spark, s.at + "/wiki/R", fetch, "Book", where)
    records, outcomes = crawl.crawl(spark, s.at + "/wiki/R", fetch, "Book", where)
    assert len(asked) == len(set(asked)) == 7  # the start is the root, and is asked for once
    got = [(r["page_no"], r["chapter"], r["title"], r["source_url"].rpartition("/")[2], r["text"]) for r in records.orderBy("page_no").collect()]
    # The moved page keeps the title that was asked for.
    assert got == [(1, "b", "R/b", "index.php?curid=5", "text b"), (2, "a", "R/a", "a", "text a"), (3, "c", "R/c", "c", "text c"), (4, "d", "R/d", "d", "text d")]
    assert {r["outcome"]: r["pages"] for r in outcomes.collect()} == {"page": 4}


def test_a_crawl_by_the_source_of_web_pages(spark, site, tmp_path, monkeypatch):
    s = site(wiki(broken="d"))
    monkeypatch.setattr(landing, "DELAY", 0.01)
    monkeypatch.setattr(landing.Pace.__init__, "__defaults__", (0.01, time.monotonic, time.sleep))
    plain = web.pages
    monkeypatch.setattr(web, "pages", lambda spark, urls: plain(spark, urls, delay=0.01))
    where = f"file://{tmp_path}/frontier"
    records, outcomes = crawl.crawl(spark, s.at + "/wiki/R", None, "Book", where)
    assert {r["outcome"]: r["pages"] for r in outcomes.collect()} == {"page": 3, "http error": 1}
    n = len(s.asked)
    again, _ = crawl.crawl(spark, s.at + "/wiki/R", None, "Book", where)
    assert len(s.asked) == n and again.count() == records.count() == 3
