"""What the operators of this subpackage share: written tables, their removal, and batches of rows."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quern import shared
from quern.shipping import ship

__all__ = ["discard", "fresh_path", "map_batches", "materialize", "remember", "ship", "table", "tracked"]

_tracked: list[list[str]] = []


@contextlib.contextmanager
def tracked(made: list[str]):
    """While this holds, ``made`` gets the paths of what is written to the shared folder."""
    _tracked.append(made)
    try:
        yield made
    finally:
        _tracked.pop()


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """A written table in the shared folder, noted where paths are tracked."""
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = shared.fresh_path(spark, tag)
    for made in _tracked[-1:]:
        made.append(path)
    return path


def discard(spark: SparkSession, made: list[str], needed: DataFrame) -> None:
    """Delete the written tables of ``made`` that ``needed`` doesn't read."""
    read = needed.inputFiles()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(made):
        if not any(path.rpartition("/")[2] in f for f in read):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            made.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_remembering: dict[str, Callable[[], None]] = {}


def remember(name: str, forget: Callable[[], None]) -> None:
    """Workers live on from task to task; what they remember is one operator's at a time, and the others' goes."""
    for other in [n for n in _remembering if n != name]:
        _remembering.pop(other)()
    _remembering[name] = forget


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over slices of few rows, so that a worker holds little at a time."""
    spark = df.sparkSession
    ship(spark)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    names = df.columns
    if any("." in n or "`" in n for n in names):  # which mapInArrow would take for fields
        df = df.toDF(*[f"c{k}" for k in range(len(names))])

    def run(batches):
        for batch in batches:
            batch = batch.rename_columns(names)
            for at in range(0, batch.num_rows, 2048):
                for cols in fn(batch.slice(at, 2048)):
                    yield pa.RecordBatch.from_pydict(cols, schema=arrow)

    return df.mapInArrow(run, schema)
