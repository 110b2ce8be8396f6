"""Chat sessions followed as a stream: messages and resets in, each session's messages in order out.

An event is a session, a time, a kind (message or reset), a role and a content. A session's state is how many resets and how many messages
since the last it has seen, so it stays two numbers however long the session gets. A batch's events of a session are put in order by time (a
reset before messages of its time, then by role and content) and numbered on from the state; what a batch brought is never moved again, so
messages that come a batch later than younger ones stand after them. State lies in the checkpoint and what was written is
written once, so a stream that starts again with its checkpoint goes on with the next number.

One task puts a session's events of one batch in order, in memory; ``max_bytes`` bounds what a batch reads.

Defined results: events without a session are a session of their own, named by null; an unknown kind is a message; a null time comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.shipping import ship

EVENT = "session string, at long, kind string, role string, content string"
MESSAGE = "session string, epoch long, position long, at long, role string, content string"
RESET = "reset"


def _numbered(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    epoch, n = state.get if state.exists else (0, 0)
    rows = pd.concat(list(parts))
    # Nulls first, and then by value.
    # Times come as text, as numbers beside nulls would be floats.
    order = [((at is not None, int(at or 0)), kind != RESET, role or "", content or "", at, role, content) for at, kind, role, content in zip(_plain(rows["at"]), rows["kind"], _plain(rows["role"]), _plain(rows["content"]), strict=True)]
    out = []
    for _, is_message, _, _, at, role, content in sorted(order, key=lambda r: r[:4]):
        if not is_message:
            epoch, n = epoch + 1, 0
            continue
        out.append((key[0], epoch, n, None if at is None else int(at), role, content))
        n += 1
    state.update((epoch, n))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in MESSAGE.split(", ")], dtype=object)


def _plain(values: pd.Series) -> list:
    return [None if pd.isna(v) else v for v in values]


def followed(events: DataFrame) -> DataFrame:
    """session, epoch (resets before it), position (from 0 in its epoch), at, role and content of each message of a stream of events."""
    ship(events.sparkSession)
    rows = events.select("session", F.col("at").cast("string").alias("at"), "kind", "role", "content")
    return rows.groupBy("session").applyInPandasWithState(_numbered, MESSAGE, "epoch long, n long", "append", GroupStateTimeout.NoTimeout)


def stream(spark: SparkSession, path: str, schema: str, max_bytes: str | None = None) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of what is added to it."""
    reader = spark.readStream.schema(schema)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    # The last letter as a pattern, as a stream takes folders or patterns only.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def follow(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Takes all events that the checkpoint does not know, and writes their messages below ``out``; each is written once."""
    return followed(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transcript(spark: SparkSession, out: str, last: bool = False) -> DataFrame:
    """Messages by session, epoch and position; with ``last``, those since each session's last reset that a message followed."""
    rows = spark.read.schema(MESSAGE).parquet(out)
    if last:
        newest = rows.groupBy("session").agg({"epoch": "max"}).withColumnRenamed("max(epoch)", "newest").withColumnRenamed("session", "of")
        rows = rows.join(newest, rows["session"].eqNullSafe(newest["of"]) & (rows["epoch"] == newest["newest"])).select(*rows.columns)
    return rows
