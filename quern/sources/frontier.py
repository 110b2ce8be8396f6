"""A crawl's frontier: which URLs are known, by what, and what became of them, as a written table that a crawl resumes from.

The table is a log of events below ``path``: a URL is found (new), landed with its reply, or failed once more. What is said last
of a URL is its state. Rows are only ever added, by Spark, a file a round, so a crawl that ends at any fetch has lost at most the round it was in, and
one that begins again with the same path asks for nothing that landed. A reply with an error status has landed; only what gave no reply is
asked again, ATTEMPTS times a run at most.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import landing

EVENT = "asked string, found_by string, place long, state string, run long, at long, url string, status int, html string"
REPLIES = "asked string, url string, status int, html string"
#: URLs of a round: what may have to be fetched again if it is cut short, and what the driver holds where it fetches itself.
BATCH = 50
ATTEMPTS = 2
Land = Callable[[list[str]], DataFrame]


class Frontier:
    def __init__(self, spark: SparkSession, path: str, attempts: int = ATTEMPTS, clock: Callable[[], int] = time.time_ns):
        self.spark, self.path, self.attempts, self.clock = spark, path, attempts, clock
        self.run = clock()

    def events(self) -> DataFrame:
        """All that was ever said; nothing of a new frontier."""
        try:
            return self.spark.read.schema(EVENT).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], EVENT)

    def states(self) -> DataFrame:
        """asked, found_by, place, state, tries (failures in this run), url, status and html of each known URL, as said last."""
        last = F.struct("at", "state", "url", "status", "html")
        first = F.struct("place", "found_by")
        tries = F.count(F.when((F.col("state") == "failed") & (F.col("run") == self.run), 1)).alias("tries")
        rows = self.events().groupBy("asked").agg(F.min_by(first, "place").alias("first"), F.max_by(last, F.struct("at", "state")).alias("last"), tries)
        return rows.select("asked", "first.found_by", "first.place", "last.state", "tries", "last.url", "last.status", "last.html")

    def _say(self, rows: DataFrame, state: str | None = None) -> None:
        told = rows.withColumns({"run": F.lit(self.run).cast("long"), "at": F.lit(self.clock()).cast("long")})
        if state:
            told = told.withColumn("state", F.lit(state))
        told.select(*[c.split()[0] for c in EVENT.split(", ")]).coalesce(1).write.mode("append").parquet(self.path)

    def add(self, urls: list[str], found_by: str) -> None:
        """URLs in their order, after those that are known; known ones stay as they are."""
        known = self.states().select("asked", "place")
        first = (known.agg(F.max("place")).first()[0] or 0) + 1
        rows = self.spark.createDataFrame([(u, found_by, first + k) for k, u in enumerate(dict.fromkeys(urls))], "asked string, found_by string, place long")
        new = rows.join(known.select("asked"), "asked", "left_anti")
        self._say(new.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in (("url", "string"), ("status", "int"), ("html", "string"))]), "new")

    def due(self, limit: int = BATCH, among: list[str] | None = None) -> list[str]:
        """URLs to ask for next, first found first: new ones, and failed ones that have attempts left. ``among``: no others than these."""
        waiting = self.states().where((F.col("state") == "new") | (F.col("state") == "failed") & (F.col("tries") < self.attempts))
        if among is not None:
            waiting = waiting.join(F.broadcast(self.spark.createDataFrame([(u,) for u in among], "asked string")), "asked", "left_semi")
        return [r["asked"] for r in waiting.orderBy("tries", "place").limit(limit).select("asked").collect()]

    def record(self, replies: DataFrame, found_by: str = "") -> None:
        """``replies``: asked, url, status (null if there was none), html."""
        state = F.when(F.col("status").isNull(), "failed").otherwise("landed")
        self._say(replies.select("asked", F.lit(found_by or None).cast("string").alias("found_by"), F.lit(None).cast("long").alias("place"), state.alias("state"), "url", "status", "html"))

    def ask(self, url: str, fetch: Callable[[str], landing.Reply], found_by: str = "discovery") -> landing.Reply:
        """The reply for one URL: as it landed before, or fetched now and recorded. No reply is a RuntimeError."""
        held = self.events().where((F.col("asked") == url) & (F.col("state") == "landed")).orderBy(F.desc("at")).select("url", "html", "status").first()
        if held:
            return held["url"], held["html"], held["status"]
        place = (self.events().agg(F.max("place")).first()[0] or 0) + 1
        try:
            final, html, status = fetch(url)
        except RuntimeError:
            self._say(self.spark.createDataFrame([(url, found_by, place, "failed", url, None, None)], "asked string, found_by string, place long, state string, url string, status int, html string"))
            raise
        self._say(self.spark.createDataFrame([(url, found_by, place, "landed", final, status, html)], "asked string, found_by string, place long, state string, url string, status int, html string"))
        return final, html, status

    def advance(self, land: Land, batch: int = BATCH, among: list[str] | None = None) -> int:
        """Rounds of ``batch`` URLs until none is due; how many rounds that took. ``land`` gives the replies of a list of URLs."""
        rounds = 0
        while urls := self.due(batch, among):
            self.record(land(urls))
            rounds += 1
        return rounds


def by_driver(spark: SparkSession, fetch: Callable[[str], landing.Reply]) -> Land:
    """Replies that the driver fetches one after another, a round at a time."""

    def land(urls: list[str]) -> DataFrame:
        rows = []
        for url in urls:
            try:
                final, html, status = fetch(url)
            except RuntimeError:
                final, html, status = url, None, None
            rows.append((url, final, status, html))
        return spark.createDataFrame(rows, REPLIES)

    return land
