"""The vector index: chunks with vectors, as a Parquet folder that counts once its success mark is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import chunking, embedding
from quern.shipping import ship


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def vectors(chunks: DataFrame, make=embedding.HashEmbedder, *args) -> DataFrame:
    ship(chunks.sparkSession)
    return chunks.withColumn("embedding", embedding.passages(F.col("text"), make, *args))


def windows(prepared: DataFrame, size: int, overlap: int) -> DataFrame:
    """What ``vectors`` gives for the chunks with text of pages that are ``chunking.prepared``."""
    ship(prepared.sparkSession)
    chunks = chunking.nonempty(chunking.windows(prepared, size, overlap, prepared=True))
    return chunks.withColumn("embedding", embedding.of_buckets("buckets")).drop("buckets")


def build(chunks: DataFrame, path: str, make=embedding.HashEmbedder, *args) -> DataFrame:
    """Write the index of all chunks with text; none is a ValueError."""
    kept = chunking.nonempty(chunks)
    if kept.isEmpty():
        raise ValueError("no chunk has any text")
    vectors(kept, make, *args).write.mode("overwrite").parquet(path)
    return load(chunks.sparkSession, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"index not found at {path}; build it first")
    return spark.read.parquet(path)


def get(spark: SparkSession, path: str, chunks: DataFrame | None = None, rebuild: bool = False) -> DataFrame:
    """Load, unless a rebuild from ``chunks`` is asked for."""
    return build(chunks, path) if rebuild and chunks is not None else load(spark, path)
