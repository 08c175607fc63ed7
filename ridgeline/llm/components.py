"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import cut


#: Links of a partition between rounds.
PART = 200_000


def _pairs(*pairs: tuple[str, str]):
    return F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs)))


def _large(links: DataFrame) -> DataFrame:
    both = links.select(_pairs(("a", "b"), ("b", "a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(_pairs(("b", "m"), ("a", "m"))).where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of links (a, b: long, a <> b); component is the least node.

    Each round is written to the checkpoint folder, so a lost executor costs a round at most. The
    driver sees two numbers a round. Rounds grow with the logarithm of a component's size.
    """
    links, seen = cut(links.select("a", "b").distinct()), None
    while (mark := _mark(links)) != seen:
        links, seen = cut(_small(_large(links)).coalesce(1 + mark[0] // PART)), mark
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
