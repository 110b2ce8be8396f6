"""What a job changes in a session's settings is as before when it has ended."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

from quern.shipping import SMALL, ship


@contextlib.contextmanager
def shipped(spark: SparkSession) -> Iterator[None]:
    """The library's code on the executors, and small batches for Python as long as this holds."""
    before = {name: spark.conf.get(name) for name, *_ in SMALL}
    ship(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
