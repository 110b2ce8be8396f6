"""Chat sessions as a written table: one row a message, added as questions are answered, read in order, reset by session."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import NO_ANSWER
from quern.operators import answering
from quern.sources import index as store
from quern.streaming.answers import answer

MESSAGE = "at long, role string, content string, found boolean, sources string, error string"


class Chat:
    """Messages of one session below ``path``; each answered question is two rows, its own and the assistant's."""

    def __init__(self, spark: SparkSession, path: str, session: str, clock: Callable[[], int] = time.time_ns):
        if not session or "/" in session:
            raise ValueError("a session's name is not empty and has no slash")
        self.spark, self.path, self.clock = spark, f"{path.rstrip('/')}/session={session}", clock

    def _folder(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def messages(self) -> DataFrame:
        """All messages in the order that they came; none of a new session."""
        fs, p = self._folder()
        if not fs.exists(p):
            return self.spark.createDataFrame([], MESSAGE)
        return self.spark.read.schema(MESSAGE).parquet(self.path).orderBy("at")

    def add(self, *rows: dict) -> None:
        at = self.clock()
        made = [(at + k, r["role"], r["content"], r.get("found"), json.dumps(r.get("sources") or [], ensure_ascii=False), r.get("error")) for k, r in enumerate(rows)]
        self.spark.createDataFrame(made, MESSAGE).coalesce(1).write.mode("append").parquet(self.path)

    def reset(self) -> None:
        fs, p = self._folder()
        fs.delete(p, True)

    def ask(self, question: str, index_path: str, reply: Callable[[DataFrame, DataFrame], DataFrame] = answer) -> dict | None:
        """The assistant's message for a question; blank ones are ignored. An error is a message with its class."""
        question = (question or "").strip()
        if not question:
            return None
        said = {"role": "assistant", "content": "", "found": False, "sources": [], "error": None}
        try:
            asked = self.spark.createDataFrame([(0, question)], "query_id long, question string")
            got = reply(asked, store.load(self.spark, index_path)).first()
            said |= {"content": got["answer"] or NO_ANSWER, "found": bool(got["found"]), "sources": [s.asDict() for s in got["sources"] or []]}
        except Exception as e:  # shown to who asks, as any failure of the page is
            text = answering.error_text(e)
            one = self.spark.createDataFrame([(text,)], "text string").select(answering.error_class(F.col("text")))
            said["error"] = "index_missing" if isinstance(e, FileNotFoundError) else one.first()[0]
        self.add({"role": "user", "content": question}, said)
        return said
