"""The shared folder, written tables, and input that is spread over the cores at hand."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where no such folder is set, in a local session, one is made and set; on a cluster that is an error, as
    executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quern-shared-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new place in the application's own part of the shared folder, which may go when the application has ended."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    # With its file system's name, so that readers other than Spark find it as well.
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def materialize(spark: SparkSession, df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = fresh_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_once(spark: SparkSession, tag: str, sources: DataFrame, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The written table of ``make()`` for these source files, as they are now, and this key; written by who asks first.

    It lies in the application's part of the shared folder and counts once its success mark is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    digest = hashlib.sha256(repr(key).encode())
    for file in sorted(sources.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(file)
        status = p.getFileSystem(conf).getFileStatus(p)
        digest.update(f"{file} {status.getLen()} {status.getModificationTime()}\n".encode())
    p = jvm.org.apache.hadoop.fs.Path(f"{own_dir(spark)}/{tag}-{digest.hexdigest()[:32]}")
    fs = p.getFileSystem(conf)
    path = p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


#: Bytes of its files that a task should get at most, about.
TASK_BYTES = 16 << 20


def _file_bytes(df: DataFrame) -> int:
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(file) for file in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def spread(df: DataFrame) -> DataFrame:
    """Input is dealt out where it has fewer partitions than cores, or one of them has more than twice its share of the rows.

    A share is what TASK_BYTES of the files hold, or one core's part if that is less. Spark's splits may be eight times as large, and those of a file with
    few row groups may be one large and many empty ones; a task would grow with the input. Other input stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-_file_bytes(df) // TASK_BYTES))
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(parts)
    # Of Parquet this reads no column, only what files say of their row groups.
    held = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    return df.repartition(parts) if held["all"] and held["most"] > 2 * -(-held["all"] // parts) else df
