"""Connected components by alternating large and small stars, as joins and minima.

Defined results: an edge from a node to itself and repeated edges tell nothing; a node without other edges, and an empty
table, give no rows; nodes are not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize

MAX_ROUNDS = 60


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node and component (its smallest node, itself included) of each node of ``edges`` (a long, b long).

    Each round hangs nodes on smaller neighbours; it ends when a round changes nothing, after about log n rounds.
    Minima are combined before they are shuffled, and written before they are joined: both sides of a join are then
    plain tables, so the rows of a star's centre, which one key holds, can be split over many tasks.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(spark, now, "stars")
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(spark, large, "large")
        low = materialize(spark, large.groupBy("u").agg(F.min("v").alias("m")), "low")
        # Of what hangs on u, all but the smallest moves to the smallest.
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(spark, small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
