"""Running values along a key's history, without one task for a key that has very many rows (WIN-01).

Keys of more than HOT rows, of which there are as few as rows / HOT, are cut into PARTS between
quantiles of the first order column. Windows run within the parts; what the parts before add is one
row for each part, and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.session import cut

HOT, PARTS = 1 << 20, 64


def _parted(df: DataFrame, keys: list[str], first: str) -> DataFrame | None:
    """df with _bounds (null: a key with few rows) and _part; None if no key has many rows, or the order has no quantiles."""
    if not isinstance(df.schema[first].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return None
    if df.count() <= HOT:  # no key can have more rows; a table of files tells by its footers
        return None
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(*keys)
    if many.isEmpty():
        return None
    hot = cut(many)
    kind = df.schema[first].dataType
    value = F.col(first).cast("timestamp") if isinstance(kind, T.TimestampNTZType) else F.col(first)
    at = [i / PARTS for i in range(1, PARTS)]
    bounds = df.join(F.broadcast(hot), keys).groupBy(*keys).agg(F.percentile_approx(value, at, 10_000).alias("_bounds"))
    out = df.join(F.broadcast(cut(bounds)), keys, "left")
    return out.withColumn("_part", F.coalesce(F.size(F.filter("_bounds", lambda b: b <= value)), F.lit(0)))


def _with_carry(df: DataFrame, keys: list[str], total: Column, carry: Column) -> DataFrame:
    parts = df.where("_bounds is not null").groupBy(*keys, "_part").agg(total.alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows of a key
    return df.join(F.broadcast(parts.withColumn("_carry", carry.over(before)).drop("_total")), [*keys, "_part"], "left")  # PARTS rows for each key of many rows


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over a key's rows up to each one."""
    columns = [*df.columns, name]
    parted = _parted(df, keys, order[0])
    window = Window.partitionBy(*keys, *([] if parted is None else ["_part"])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if parted is None:
        return df.withColumn(name, F.sum(value).over(window))
    parted = _with_carry(parted.withColumn("_value", value), keys, F.sum("_value"), F.sum("_total"))
    return parted.withColumn(name, F.sum("_value").over(window) + F.coalesce("_carry", F.lit(0))).select(columns)


def running_last(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value, null left out, at or before each row."""
    columns = [*df.columns, name]
    parted = _parted(df, keys, order[0])
    window = Window.partitionBy(*keys, *([] if parted is None else ["_part"])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if parted is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(window))
    parted = parted.withColumn("_value", value)
    total = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    parted = _with_carry(parted, keys, total, F.last("_total", ignorenulls=True))
    return parted.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(window), "_carry")).select(columns)
