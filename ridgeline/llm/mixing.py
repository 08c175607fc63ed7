"""Mixing sources to target weights by entropy balancing.

The mix takes words of each document at a rate as close to one, in relative entropy, as its
source's token constraint allows: rate = min(most, exp(x * size / mean size)), where x solves the
source's convex dual. Newton steps for all sources run together over a histogram of sizes until
every source meets its target. A rate becomes whole copies and the words of a last, begun copy.

Everything is DataFrame functions. Sums are of decimals, which do not depend on the order of
adding, so reruns agree. Only counts travel: the histogram has a row for each source and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut

#: Newton steps at most; a step outside its bracket halves the bracket instead.
STEPS = 80
#: Up to so many sources, their numbers are broadcast; beyond, they are joined by shuffling.
FEW = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: float) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3 and so on, and share the sum of all
    sizes. A target stops at most * source_size; the excess is shared by weight among the others
    until none is above: target = min(cap, weight * level), where the level makes the sum right.
    The windows here run over a row for each source, not for each document.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = lambda c: F.sum(c).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left("weight"))
    ranked = ranked.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    level = F.first("open", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("level", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def _by_source(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """rows with the columns of their source's row, null matching null."""
    other = sources.withColumnRenamed("source", "_source")
    other = F.broadcast(other) if n <= FEW else other
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _rate(most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col("x") * F.col("size") / F.col("mean"), F.lit(40.0))))


def balance(histogram: DataFrame, goals: DataFrame, n_sources: int, most: float) -> DataFrame:
    """source, source_size, target, x, mean, from source, size, n and source, source_size, target."""
    held = histogram.where("size > 0")
    shape = held.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("docs"), F.min("size").alias("least"))
    state = goals.join(shape, F.col("source").eqNullSafe(F.col("_s"))).withColumn("mean", F.col("source_size") / F.col("docs"))
    span = F.col("mean") / F.col("least")
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)  # every rate is at its bound
    top = F.log(F.lit(float(most))) * span * (1 + 1e-9)
    state = cut(state.select("source", "source_size", "target", "mean", F.when(full, top).otherwise(0.0).alias("x"), (-60 * span).alias("lo"), top.alias("hi"), full.alias("done")))
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    words = F.col("n") * F.col("size")
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        rows = _by_source(held, state.select("source", "x", "mean"), n_sources).withColumn("r", _rate(most))
        slope = F.when(F.col("r") < most, words * F.col("size") / F.col("mean") * F.col("r")).otherwise(0.0)
        sums = rows.groupBy(F.col("source").alias("_s")).agg(exact(words * F.col("r")).alias("taken"), exact(slope).alias("slope"))
        now = state.join(sums, F.col("source").eqNullSafe(F.col("_s")))
        short = F.col("taken") < F.col("target")
        now = now.withColumn("lo", F.when(short, F.col("x")).otherwise(F.col("lo"))).withColumn("hi", F.when(short, F.col("hi")).otherwise(F.col("x")))
        newton = F.col("x") + (F.col("target") - F.col("taken")) / F.when(F.col("slope") > 0, F.col("slope"))
        step = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.abs(F.col("taken") - F.col("target")) <= 1e-7 * F.col("target")
        now = now.withColumn("x", F.when(F.col("done") | done, F.col("x")).otherwise(step)).withColumn("done", F.col("done") | done)
        state = cut(now.select(state.columns))
    return state.select("source", "source_size", "target", "x", "mean")


def _solved(sized: DataFrame, most: float) -> tuple[DataFrame, int]:
    """source, source_size, target, x, mean for rows of source and size; the number of sources."""
    histogram = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = cut(targets(sizes, most))
    n_sources = goals.count()
    solved = balance(histogram, goals, n_sources, most)
    empty = goals.where("source_size = 0").select("source", "source_size", "target", F.lit(0.0).alias("x"), F.lit(1.0).alias("mean"))
    return cut(solved.unionByName(empty)), n_sources


def _planned(rows: DataFrame, sources: DataFrame, n_sources: int, most: int, seed: int) -> DataFrame:
    """rows of id, source, size (and more) with source_size, target, rate, taken, copies, begun. Nothing is shuffled if sources are few."""
    out = _by_source(rows, sources, n_sources).withColumn("rate", F.when(F.col("size") > 0, _rate(most)).otherwise(0.0)).drop("x", "mean")
    up = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = out.withColumn("taken", F.least(F.floor(F.col("rate") * F.col("size") + up), most * F.col("size")).cast("long"))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int"))
    return out.withColumn("begun", F.col("taken") - F.col("copies") * F.col("size"))


def mix(docs: DataFrame, most: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """id, source, size, source_size, target, rate, taken, copies, begun for each row of docs.

    taken: words of the document that the mix takes, repeats counted: copies whole copies and the
    first `begun` words of one more; never more than most * size. Each source's taken words differ
    from its target by the rounding of each document to a whole word, up or down by a hash of its id.

    Null and empty texts, and texts of blanks, have size 0 and nothing is taken. A null source is a
    source, the last. Rows that repeat an id count each and are rounded alike. A source without
    words has target 0. An empty table gives no rows. Other columns are not looked at.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")))
    out = _planned(rows, *_solved(rows, most), most, seed)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "taken", "copies", "begun")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mixed(docs: DataFrame, most: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """docs as the mix has them: each row as often as it has copies, a begun copy cut after its words; columns as before. Texts are not shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("row"))
    out = _planned(rows, *_solved(rows.select("source", "size"), most), most, seed)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies") + (F.col("begun") > 0).cast("int")))
    out = out.where("copies > 0 or begun > 0").select("row", "copies", "begun", copies.alias("copy"))
    text = F.col(f"row.{_quoted(text_col)}")
    start = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("begun").cast("int")), "")
    columns = {c: F.col(f"row.{_quoted(c)}") for c in docs.columns}
    part = F.col("copy") > F.col("copies")
    columns[text_col] = F.when(part, start).otherwise(text)
    if "n_chars" in columns:
        columns["n_chars"] = F.when(part, F.length(start).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*(c.alias(name) for name, c in columns.items()))
