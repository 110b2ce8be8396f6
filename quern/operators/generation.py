"""Many prompts for a model server: a bounded pool of requests in each Python worker, and failures that stay with their rows.

A worker keeps one pool and one client for all its batches. ``width`` requests are under way at a time, a batch's answers are given in its
order, and the next batch is asked only then, so a worker holds one batch. A request that fails is tried again after growing pauses;
what still fails is the error of its row, and all other rows have their answers. Requests under way at a time are ``width`` for each
task that runs, so partitions of the prompts bound what the server meets.
"""

from __future__ import annotations

import http.client
import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import SETTINGS
from quern.operators import answering
from quern.operators.embedding import loaded

WIDTH, ATTEMPTS, PAUSE, TIMEOUT = 8, 3, 0.5, 120.0
#: Statuses that another try may mend.
BUSY = frozenset((408, 425, 429, 500, 502, 503, 504))


class Refused(ValueError):
    """The server answered that it won't; trying again is no use."""


class ChatServer:
    """A chat server, one kept connection a thread. Failures are ConnectionError, or Refused where trying again is no use."""

    def __init__(self, url: str = SETTINGS.ollama_base_url, model: str = SETTINGS.ollama_model, timeout: float = TIMEOUT, temperature: float = 0.0, seed: int = 0):
        self.url, self.model, self.timeout, self.options = url.rstrip("/"), model, timeout, {"temperature": temperature, "seed": seed}
        self.mine = threading.local()

    def _post(self, path: str, body: bytes) -> tuple[int, bytes]:
        parts = urlsplit(self.url)
        if getattr(self.mine, "connection", None) is None:
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            self.mine.connection = kind(parts.netloc, timeout=self.timeout)
        try:
            self.mine.connection.request("POST", parts.path + path, body, {"Content-Type": "application/json"})
            reply = self.mine.connection.getresponse()
            return reply.status, reply.read()
        except (OSError, http.client.HTTPException) as e:
            self.mine.connection.close()
            self.mine.connection = None
            raise ConnectionError(f"failed to connect to the model server at {self.url}: {e or type(e).__name__}") from e

    def __call__(self, prompt: str) -> str:
        messages = [{"role": "system", "content": answering.SYSTEM}, {"role": "user", "content": prompt}]
        body = json.dumps({"model": self.model, "messages": messages, "stream": False, "options": self.options}).encode()
        status, said = self._post("/api/chat", body)
        told = said.decode("utf-8", "replace")
        if status in BUSY:
            raise ConnectionError(f"the model server at {self.url} answered {status}: {told[:500]}")
        if status >= 400:
            raise Refused(f"the model server at {self.url} answered {status}: {told[:500]}")
        try:
            return answering.content_text(json.loads(told)["message"]["content"])
        except (KeyError, TypeError, ValueError) as e:
            raise Refused(f"the model server at {self.url} gave no answer: {told[:500]}") from e


def tried(client: Callable[[str], str], prompt: str | None, attempts: int, pause: float) -> tuple[str | None, str | None]:
    """What the client says, or else the text of the last error."""
    if prompt is None:
        return None, None
    for n in range(1, attempts + 1):
        try:
            return client(prompt), None
        except Exception as e:  # noqa: BLE001  an error of any kind belongs to its row
            if n == attempts or isinstance(e, Refused):
                return None, f"{type(e).__name__}: {answering.error_text(e)}"
        time.sleep(pause * n)
    raise AssertionError


def generate(
    column: Column, make: Callable[..., answering.Generator] = ChatServer, *args, width: int = WIDTH, attempts: int = ATTEMPTS, pause: float = PAUSE
) -> Column:
    """A struct of said and error, one of them null; both for a null prompt. ``make(*args)`` gives a client that threads may share."""

    @F.pandas_udf("said string, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client, pool = loaded(make, *args), loaded(ThreadPoolExecutor, width)
        for prompts in parts:
            given = list(pool.map(lambda p: tried(client, p, attempts, pause), prompts))
            yield pd.DataFrame(given, columns=["said", "error"], dtype=object)

    return run(column)


def answers(
    questions: DataFrame, hits: DataFrame, limit: int = SETTINGS.generation_k, make: Callable[..., answering.Generator] = ChatServer, *args, **pool
) -> DataFrame:
    """query_id, answer, found, sources and error (its class, or null) of every question; a question whose prompt failed has no answer."""
    found = answering.contexts(hits, limit)
    told = answering.prompts(found, questions).select("query_id", generate(F.col("prompt"), make, *args, **pool).alias("got"))
    said = told.select("query_id", "got.said", F.when(F.col("got.error").isNotNull(), answering.error_class(F.col("got.error"))).alias("error"))
    return answering.answered(questions, found, said, "error")
