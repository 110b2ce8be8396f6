"""Landing of web pages, apart from Spark: polite, with retries. Spark reads what it lands."""

from __future__ import annotations

import http.client
import re
import time
from collections.abc import Callable
from urllib.parse import quote, urljoin, urlsplit

AGENT = "quern-landing/0.1"
HEADERS = {"User-Agent": AGENT, "Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8"}
SAFE = "%/:=&?~+!$,;'@()*[]"
REDIRECTS, MOST_REDIRECTS = frozenset((301, 302, 303, 307, 308)), 10
DELAY, TIMEOUT, ATTEMPTS = 1.0, 30, 3
RETRIED = frozenset((429, 500, 502, 503, 504))
Reply = tuple[str, str, int]


class Pace:
    """At least ``delay`` seconds between calls, on a clock that only goes forward."""

    def __init__(self, delay: float = DELAY, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.delay, self.clock, self.sleep, self.last = delay, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (left := self.last + self.delay - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()


class Session:
    """Requests over one kept connection to each host, with this program's headers; redirects are followed.

    A connection that the server has closed meanwhile is opened anew, once for a request. Characters that URLs can't hold are
    percent-encoded on the way. The text is decoded by the reply's charset, else the page's own, else as UTF-8, else as Windows-1252.
    """

    def __init__(self, timeout: float = TIMEOUT):
        self.timeout, self.kept = timeout, {}

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for connection in self.kept.values():
            connection.close()
        self.kept.clear()

    def _ask(self, url: str) -> tuple[int, http.client.HTTPMessage, bytes]:
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.netloc:
            raise OSError(f"no web address: {url}")
        host = (parts.scheme, parts.netloc.rpartition("@")[2])
        target = quote(parts.path or "/", safe=SAFE) + (f"?{quote(parts.query, safe=SAFE)}" if parts.query else "")
        for new in (host not in self.kept, True):
            try:
                if new:
                    self.kept.pop(host, None)
                    kind = http.client.HTTPSConnection if host[0] == "https" else http.client.HTTPConnection
                    self.kept[host] = kind(host[1].encode("idna").decode(), timeout=self.timeout)
                self.kept[host].request("GET", target, headers=HEADERS)
                reply = self.kept[host].getresponse()
                return reply.status, reply.headers, reply.read()
            except (http.client.HTTPException, OSError, ValueError) as e:
                if host in self.kept:
                    self.kept.pop(host).close()
                if new:
                    raise e if isinstance(e, OSError) else OSError(f"{url}: {e}") from e
        raise AssertionError

    def get(self, url: str) -> Reply:
        """Final URL, text and status of one request; an error status is a reply, a lost connection an OSError."""
        for _ in range(MOST_REDIRECTS + 1):
            status, headers, body = self._ask(url)
            to = headers.get("Location")
            if status not in REDIRECTS or not to:
                return url, decoded(body, headers.get_content_charset()), status
            url = urljoin(url, to)
        raise OSError(f"{url}: more than {MOST_REDIRECTS} redirects")


def decoded(body: bytes, charset: str | None = None) -> str:
    told = re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", body[:2048], re.IGNORECASE)
    for name in filter(None, (charset, told and told[1].decode(), "utf-8")):
        try:
            return body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("cp1252", "replace")


def get(url: str) -> Reply:
    """One request over a connection of its own."""
    with Session() as session:
        return session.get(url)


def fetch(url: str, pace: Pace, allow_error: bool = False, get: Callable[[str], Reply] = get, attempts: int = ATTEMPTS) -> Reply:
    """Up to ``attempts`` requests: busy statuses and lost connections are tried again after growing pauses.

    With ``allow_error`` the last reply counts whatever its status; an earlier one never stands in for a later failure.
    """
    lost: Exception | None = None
    for n in range(1, attempts + 1):
        pace.wait()
        try:
            reply = get(url)
            busy = reply[2] in RETRIED
            if not busy or n == attempts:
                if reply[2] < 400 or allow_error:
                    return reply
                raise OSError(f"status {reply[2]}")
        except OSError as e:
            lost = e
        if n < attempts:
            pace.sleep(pace.delay * n)
    raise RuntimeError(f"could not fetch {url}") from lost


def listing_pages(url: str, fetch_page: Callable[[str], Reply], next_of: Callable[[str, str], str | None]) -> list[Reply]:
    """A listing and the pages that follow it; an error status, no next link, or a link back ends it."""
    out: list[Reply] = []
    seen: set[str] = set()
    at: str | None = url
    while at and at not in seen:
        seen.add(at)
        reply = fetch_page(at)
        if reply[2] >= 400:
            break
        out.append(reply)
        at = next_of(reply[1], reply[0])
    return out


def next_link(html: str, base: str) -> str | None:
    """The link to a listing's next page, resolved, its query kept."""
    from quern.functions.html import read_page

    hrefs = [h for h, _, marks in read_page(html).links if "mw-nextlink" in marks or "rel-next" in marks]
    return urljoin(base, hrefs[0]) if hrefs else None
