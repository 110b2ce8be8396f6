"""Web pages as a Spark source: ``spark.read.format("web_pages")``, a partition a host, each at its own pace.

Options: ``urls`` (a JSON array; a collection's URLs, as many as politeness lets be fetched), ``delay`` (seconds between requests to a
host), ``attempts``, ``timeout``. Columns: position in the array, asked, url (the final one), status (null if fetching failed) and html.

URLs are split by host, so one task asks a host, over one kept connection and by one clock, and hosts are asked side by side. A task that is
run again asks its host again, so a plan that is to be evaluated more than once should be written first. What is repeated in the array is fetched once.

Defined results: no URLs give no rows; what is no web address is a row that failed; a redirect to another host is followed within the same task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.shipping import ship
from quern.sources import landing

FETCHED = "position long, asked string, url string, status int, html string"


@dataclass
class Host(InputPartition):
    name: str
    urls: list[tuple[int, str]]


def _host(url: str) -> str:
    try:
        return urlsplit(url).netloc.lower()
    except ValueError:
        return ""


class WebReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        if not isinstance(self.urls, list) or not all(isinstance(u, str) for u in self.urls):
            raise ValueError("urls must be a JSON array of strings")
        self.delay, self.attempts, self.timeout = float(options.get("delay", landing.DELAY)), int(options.get("attempts", landing.ATTEMPTS)), float(options.get("timeout", landing.TIMEOUT))

    def partitions(self) -> list[Host]:
        hosts: dict[str, dict[str, int]] = {}
        for k, url in enumerate(self.urls):
            hosts.setdefault(_host(url), {}).setdefault(url, k)
        return [Host(name, [(k, u) for u, k in urls.items()]) for name, urls in hosts.items()] or [Host("", [])]

    def read(self, partition: Host) -> Iterator[tuple]:
        pace = landing.Pace(self.delay)
        with landing.Session(self.timeout) as session:
            for k, url in partition.urls:
                try:
                    final, html, status = landing.fetch(url, pace, allow_error=True, get=session.get, attempts=self.attempts)
                except RuntimeError:
                    final, html, status = url, None, None
                yield k, url, final, status, html


class WebPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> WebReader:
        return WebReader(self.options)


def pages(spark: SparkSession, urls: list[str], **options: float) -> DataFrame:
    """The pages of ``urls``, read when the plan runs."""
    ship(spark)
    spark.dataSource.register(WebPages)
    reader = spark.read.format("web_pages").option("urls", json.dumps(urls))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
