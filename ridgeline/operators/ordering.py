"""Positions of rows in an order, without one task for a group that has very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut

#: Rows of the table of offsets up to which it is broadcast: one for each group in each task.
BROADCAST = 100_000
_ROW = (1 << 33) - 1


def numbered(df: DataFrame, group: str, order: list) -> DataFrame:
    """df with index, a row's position in its group (from 0) by `order`, and count, the group's rows.

    Rows are dealt by ranges of group, order and a running number, so neither a large group nor many
    equal rows meet in one task; equal rows take following positions. What tasks hold of each group is
    added up before, one row for a group in a task. group must not be null.
    """
    by = [F.col(group), *(F.col(c) if isinstance(c, str) else c for c in order), F.col("_u")]
    kept = cut(df.withColumn("_u", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_u"))
    placed = kept.withColumn("_at", F.monotonically_increasing_id()).withColumns({"_task": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit(_ROW))}).drop("_at")
    held = cut(placed.groupBy("_task", F.col(group).alias("_group")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n")))
    own = Window.partitionBy("_group")
    before = F.sum("_n").over(own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select(F.col("_task").alias("_t"), "_group", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("count"))
    starts = F.broadcast(starts) if held.count() <= BROADCAST else starts
    found = placed.join(starts, (F.col("_task") == F.col("_t")) & (F.col(group) == F.col("_group")))
    return found.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_row") + F.col("_shift")).alias("index"), "count")
