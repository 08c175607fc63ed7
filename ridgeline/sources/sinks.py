"""Exports of tables, graphs and reports (SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet below a folder (SNK-01)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line_no, line: a DOT graph with each pair of peers once, the first label counting (SNK-02). nodes: id; edges: src, dst, label."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "label").groupBy("a", "b").agg(F.min("label").alias("label"))
    body = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), quoted("id"), F.lit(";")).alias("line"))
    body = body.union(pairs.select(F.lit(2), F.concat(F.lit("  "), quoted("a"), F.lit(" -- "), quoted("b"), F.lit(' [label="'), "label", F.lit('"];'))))
    ends = nodes.sparkSession.createDataFrame([(0, "graph topology {"), (3, "}")], "part int, line string")
    return body.union(ends).orderBy("part", "line")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """A row of JSON for each row (SNK-03, SNK-06)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def append_log(df: DataFrame, folder: str) -> None:
    """Appends rows as JSON lines (SNK-07)."""
    df.write.mode("append").json(folder)


def script(commands: DataFrame, category: str, command: str, order: str) -> DataFrame:
    """category, lines: commands of a category under a heading, categories as first seen (SNK-09, SNK-08)."""
    rows = commands.groupBy(category).agg(F.min(order).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, command))), lambda x: x[command]), "\n").alias("lines"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first"))).select("place", F.concat(F.lit("# "), F.col(category), F.lit("\n"), "lines").alias("text"))
