"""Merge policies: how a batch of rows meets what is stored, and which rows of a history count.

Each policy is a grouping by key with an ordered pick, so one exchange with partial aggregation;
no window over a key's whole history. Results are new tables: write them to a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of each key the row with the least order, which must not tie (AGG-02)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(df.columns)


def last_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of each key the row with the greatest order, which must not tie (UPS-02, 03, 04, 08, 11)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(df.columns)


def newer_wins(stored: DataFrame, batch: DataFrame, keys: list[str], updated: str, seq: str) -> DataFrame:
    """The row with the latest time; of equal times the later one in sequence, and the batch over what is stored."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return last_by(both, keys, F.struct(updated, "_new", seq)).drop("_new")


def keep_filled(df: DataFrame, keys: list[str], order: Column, filled: list[str]) -> DataFrame:
    """The last row of each key, where the columns `filled` keep their last value that is not empty (UPS-01)."""
    plain = [c for c in df.columns if c not in keys and c not in filled]
    some = lambda c: (F.col(c) != "") & F.col(c).isNotNull()
    picks = [F.max_by(c, order).alias(c) for c in plain]
    picks += [F.coalesce(F.max_by(F.when(some(c), F.col(c)), F.when(some(c), order)), F.max_by(c, order)).alias(c) for c in filled]
    return df.groupBy(*keys).agg(*picks).select(df.columns)


def insert_absent(stored: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows of the batch whose key is nowhere in what is stored, the first of each key (UPS-07, 10)."""
    fresh = batch.join(stored.select(*keys).distinct(), keys, "left_anti")
    return first_by(fresh, keys, order)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many (UPS-06: these would abort an insert)."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def newest(df: DataFrame, n: int, order: str) -> DataFrame:
    """The n rows with the greatest order: a pad that forgets (UPS-12)."""
    return df.orderBy(F.desc(order)).limit(n)


def counted(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys with the number of rows and the first and last time (AGG-15)."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of each key's greatest version (AGG-03, AGG-04)."""
    top = df.groupBy(key).agg(F.max(version).alias(version))
    return df.join(top, [key, version])


def versions(df: DataFrame, key: str, version: str, n: int) -> DataFrame:
    """The n greatest versions of each key (AGG-05)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(version))
    return df.select(key, version).distinct().withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def changed_texts(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """A key's texts that were not there before, anywhere in its history, with `changed`: whether another came before (UPS-07)."""
    from pyspark.sql import Window

    first = first_by(df.withColumn("content_hash", F.sha2(text, 256)), [key, "content_hash"], F.col(order))
    w = Window.partitionBy(key).orderBy(order)
    return first.withColumn("changed", F.lag("content_hash").over(w).isNotNull())


def cascade(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose key is gone (UPS-13)."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def affected(rows: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key was changed (JOIN-11)."""
    return rows.join(changed.select(*keys).distinct(), keys, "left_semi")


def transition(rows: DataFrame, status: str, allowed: dict[str, tuple[str, ...]], to: str, where: Column) -> DataFrame:
    """rows with the status moved where asked and allowed (UPS-15)."""
    may = [s for s, targets in allowed.items() if to in targets]
    return rows.withColumn(status, F.when(where & F.col(status).isin(*may), F.lit(to)).otherwise(F.col(status)))


def insert_unique(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the batch behind it; a key that would be there twice aborts the whole insert (UPS-06)."""
    if not duplicates(stored.select(*keys).union(batch.select(*keys)), keys).isEmpty():
        raise ValueError(f"rows repeat {', '.join(keys)}")
    return stored.unionByName(batch)


def touched(stored: DataFrame, changed: DataFrame, keys: list[str], updated: str, at: Column) -> DataFrame:
    """stored with the time of change set on the rows whose key was changed (UPS-14)."""
    hit = changed.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return stored.join(hit, keys, "left").withColumn(updated, F.when(F.col("_hit"), at).otherwise(F.col(updated))).select(stored.columns)
