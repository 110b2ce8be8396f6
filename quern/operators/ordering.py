"""Places of rows within their groups, counted over range partitions, so that no group has to fit in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.shared import materialize

_BITS = 33
_MADE = ("at_", "part_", "n_", "before_", "group_", "first_", "held_")


def positions(
    spark: SparkSession, rows: DataFrame, group: str, order: list[str], write: Callable[[SparkSession, DataFrame, str], DataFrame] = materialize
) -> DataFrame:
    """``rows`` with ``position``: their place, from 0, in the order within their group; null is a group as well.

    Rows are sorted by range over all partitions and numbered there. A group's rows then meet its first place by
    partition and group, so a group that spans many partitions spreads over many tasks here too. ``rows`` should be
    a written table, as sorting by range reads it twice. Rows that are equal in ``order`` get places in any order.
    """
    if taken := {*_MADE, "position"} & set(rows.columns):
        raise ValueError(f"columns {sorted(taken)} are made here")
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    # Within a partition this counts up from 0; the partition's number lies above.
    spread = write(spark, spread.withColumn("at_", F.monotonically_increasing_id()), "positions")
    part, own = F.shiftright("at_", _BITS), F.col("at_").bitwiseAND(F.lit((1 << _BITS) - 1))
    spread = spread.withColumns({"part_": part, "at_": own})
    # A row for each partition, so one task may sum them up and all may hold them.
    sizes = spread.groupBy("part_").agg((F.max("at_") + 1).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("part_", before.alias("before_"))
    # A row for each group and partition that holds some of it.
    starts = spread.groupBy("part_", F.col(group).alias("group_")).agg(F.min("at_").alias("held_")).join(F.broadcast(before), "part_")
    first = F.min(F.col("before_") + F.col("held_")).over(Window.partitionBy("group_"))
    starts = starts.select(F.col("part_").alias("held_"), "group_", (first - F.col("before_")).alias("first_"))
    out = spread.join(starts, (F.col("part_") == F.col("held_")) & F.col(group).eqNullSafe(F.col("group_")))
    return out.withColumn("position", F.col("at_") - F.col("first_")).drop(*_MADE)
