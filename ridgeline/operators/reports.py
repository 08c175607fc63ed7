"""Summaries and comparisons: group summaries, coverage, differences, checks (AGG, SET, QRY, STA)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.plans.program import ProgramError, run


def group_summary(df: DataFrame, group: Column, name: str, distinct: str, sample: str, order: Column, n: int = 3) -> DataFrame:
    """group, rows, distinct values, and the first n samples by order, joined by commas (AGG-06, AGG-08).

    Samples are ranked before they are gathered, so a group of any size gathers n.
    """
    ranked = df.withColumn(name, group).withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(order)))
    first = ranked.where(F.col("_n") <= n).groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(sample).cast("string").alias("s")))), lambda x: x["s"]), ",").alias("samples"))
    whole = df.withColumn(name, group).groupBy(name).agg(F.count("*").alias("members"), F.count_distinct(distinct).alias("different"))
    return whole.join(first, name)


def coverage(df: DataFrame, keys: list[str], covered: Column) -> DataFrame:
    """keys, total, covered, pct (AGG-09)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(covered).alias("covered"))
    return out.withColumn("pct", F.col("covered") / F.col("total") * 100)


def buckets(checked: DataFrame) -> DataFrame:
    """How many are covered in full, in part, not at all, and the mean (AGG-10)."""
    return checked.agg(F.count("*").alias("groups"), F.avg("pct").alias("avg_pct"), F.count_if(F.col("pct") >= 100).alias("full"), F.count_if((F.col("pct") > 0) & (F.col("pct") < 100)).alias("part"), F.count_if(F.col("pct") == 0).alias("none"))


def filled_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rate of values that are not blank, ok if half or more (AGG-16): one pass, then a row for each column."""
    one = df.agg(*(F.avg(F.when(F.trim(F.col(c).cast("string")) != "", 1.0).otherwise(0.0)).alias(c) for c in columns))
    return one.unpivot([], columns, "field", "rate").withColumn("ok", F.col("rate") >= 0.5)


def line_difference(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """keys, side (- or +), pos, line: lines of one text that the other has not (SET-01). Both texts are in one row, so nothing is joined."""
    lines = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1)
    gone = lambda a, b, sign: F.filter(F.transform(lines(a), lambda x, i: F.struct(F.lit(sign).alias("side"), i.alias("pos"), x.alias("line"))), lambda s: ~F.array_contains(lines(b), s["line"]))
    return pairs.select(*keys, F.explode(F.concat(gone(old, new, "-"), gone(new, old, "+"))).alias("d")).select(*keys, "d.*")


def row_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, field, expected, actual of cells that differ, or of rows that one side lacks (QRY-03, QRY-09)."""
    left = a.select(*keys, F.struct(*(F.trim(F.col(c).cast("string")).alias(c) for c in columns)).alias("x"))
    right = b.select(*keys, F.struct(*(F.trim(F.col(c).cast("string")).alias(c) for c in columns)).alias("y"))
    both = left.join(right, keys, "full")
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"x.{c}").alias("expected"), F.col(f"y.{c}").alias("actual")) for c in columns))
    return both.select(*keys, F.explode(F.filter(cells, lambda s: ~s["expected"].eqNullSafe(s["actual"]))).alias("c")).select(*keys, "c.*")


def within_budget(messages: DataFrame, conversation: str, turn: str, text: str, budget: int, least: int = 3) -> DataFrame:
    """The messages that stay when the oldest after the first go until all fit the budget or `least` are left (STA-05)."""
    back = Window.partitionBy(conversation).orderBy(F.desc(turn))
    on = Window.partitionBy(conversation).orderBy(turn)
    rows = messages.withColumn("_len", F.coalesce(F.length(text), F.lit(0)))
    rows = rows.withColumns({"_first": F.row_number().over(on) == 1, "_rank": F.row_number().over(back), "_sum": F.sum("_len").over(back), "_head": F.first("_len").over(on)})
    keep = F.col("_first") | (F.col("_sum") + F.col("_head") <= budget) | (F.col("_rank") < least)
    return rows.where(keep).drop("_len", "_first", "_rank", "_sum", "_head")


def truncated_middle(text: Column, most: int = 2000) -> Column:
    """Head and tail of a text that is too long, with a mark between (FN-22)."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(half)))).otherwise(text)


def repeated_prefixes(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """key, prefix, lines: first two words that n lines of a text or more share (AGG-17)."""
    lines = df.select(key, F.explode(F.split(text, "\n", -1)).alias("line"))
    prefix = F.regexp_extract("line", r"^\s*(\S+\s+\S+)", 1)
    return lines.select(key, F.regexp_replace(prefix, r"\s+", " ").alias("prefix")).where("prefix <> ''").groupBy(key, "prefix").agg(F.count("*").alias("lines")).where(F.col("lines") >= n)


# How blocks of outputs begin.
BLOCKS = (r"(?i)^Route-policy:\s+", r"(?i)^(Basic|Advanced|Layer 2) IPv[46] ACL\s+", r"(?i)^interface\s+\S+", r"(?i)^BGP Peer\s+", r"(?i)^Tunnel\s+\d+", r"(?i)^VPN Instance:\s+", r"(?i)^ip prefix-list\s+", r"(?i)^community-filter\s+")


def too_few_rows(df: DataFrame, key: str, text: str, rows: str) -> DataFrame:
    """key, what, blocks, rows: samples that hold three blocks or more of a kind, or as many lines of one beginning, of
    which less than half came out as rows (AGG-17). Blocks by pattern count before beginnings; of these the commonest, then the first by name."""
    ls = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), F.trim)
    counts = F.array(*(F.struct(F.lit(0).alias("order"), F.lit(i).alias("place"), F.lit(p).alias("what"), F.size(F.filter(ls, lambda x: x.rlike(p))).cast("long").alias("blocks")) for i, p in enumerate(BLOCKS)))
    few = lambda n: (n >= 3) & (F.col(rows) < F.floor(n / 2))
    known = df.where(F.size(ls) >= 5).select(key, rows, F.explode(F.filter(counts, lambda c: few(c["blocks"]))).alias("c")).select(key, rows, "c.*")
    prefix = F.regexp_extract("line", r"^(\S+(?:\s+\S+)?)", 1)
    lines = df.where(F.size(ls) >= 5).select(key, rows, F.explode(ls).alias("line")).where("length(line) > 2").select(key, rows, F.regexp_replace(prefix, r"\s+", " ").alias("what")).where("what rlike '^[A-Za-z]'")
    begun = lines.groupBy(key, rows, "what").agg(F.count("*").alias("blocks")).where(few(F.col("blocks"))).select(key, rows, F.lit(1).alias("order"), (-F.col("blocks")).cast("int").alias("place"), "what", "blocks")
    best = known.union(begun).groupBy(key, rows).agg(F.min_by(F.struct("what", "blocks"), F.struct("order", "place", "what")).alias("b"))
    return best.select(key, "b.what", "b.blocks", rows)


def self_test(samples: DataFrame, program: str, key: str, text: str) -> DataFrame:
    """key, level, rows, rate, passed of a line program on each sample (AGG-16): -1 if it is no program, 1 if it gives no
    rows, 2 if less than half of the fields are filled, else 3."""
    try:
        found = run(samples, program, text, [key])
    except ProgramError:
        return samples.select(key, F.lit(-1).alias("level"), F.lit(0).cast("long").alias("rows"), F.lit(None).cast("double").alias("rate"), F.lit(False).alias("passed"))
    fields = [c for c in found.columns if c not in (key, "row_no")]
    filled = sum((F.when(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != "", 1).otherwise(0) for c in fields), F.lit(0))
    told = found.groupBy(key).agg(F.count("*").alias("rows"), (F.sum(filled) / F.lit(max(1, len(fields))) / F.count("*")).alias("rate"))
    out = samples.select(key).join(told, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    level = F.when(F.col("rows") == 0, 1).when(F.col("rate") < 0.5, 2).otherwise(3)
    return out.select(key, level.alias("level"), "rows", "rate", (level == 3).alias("passed"))


def _meeting(x: list[str], y: list[str]) -> tuple[int, int, int, int]:
    """Where the furthest-reaching paths from both ends of two lists meet: a run of equal lines, from its start to its end, that may be empty."""
    n, m = len(x), len(y)
    most = (n + m + 1) // 2
    ahead, behind = {1: 0}, {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            i = ahead[k + 1] if k == -d or k != d and ahead[k - 1] < ahead[k + 1] else ahead[k - 1] + 1
            j = at = i - k
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            ahead[k] = i
            back = n - m - k
            if (n - m) % 2 and abs(back) < d and back in behind and i + behind[back] >= n:
                return at + k, at, i, j
        for k in range(-d, d + 1, 2):
            i = behind[k + 1] if k == -d or k != d and behind[k - 1] < behind[k + 1] else behind[k - 1] + 1
            j = at = i - k
            while i < n and j < m and x[n - i - 1] == y[m - j - 1]:
                i, j = i + 1, j + 1
            behind[k] = i
            fore = n - m - k
            if (n - m) % 2 == 0 and abs(fore) <= d and fore in ahead and i + ahead[fore] >= n:
                return n - i, m - j, n - at - k, m - at
    raise AssertionError("paths meet")


def shortest_script(x: list[str], y: list[str]) -> list[tuple[str, str]]:
    """A shortest edit script of two lists, in memory that grows with their lengths: what lies before and behind the
    middle of a shortest path is done by itself."""
    out, left = [], [(0, len(x), 0, len(y))]
    while left:
        xlo, xhi, ylo, yhi = left.pop()
        if xhi < 0:  # a run of equal lines
            out += [(" ", line) for line in x[xlo : -xhi]]
            continue
        start = xlo
        while xlo < xhi and ylo < yhi and x[xlo] == y[ylo]:
            xlo, ylo = xlo + 1, ylo + 1
        out += [(" ", line) for line in x[start:xlo]]
        end = xhi
        while xlo < xhi and ylo < yhi and x[xhi - 1] == y[yhi - 1]:
            xhi, yhi = xhi - 1, yhi - 1
        if end > xhi:
            left.append((xhi, -end, 0, 0))
        if xlo == xhi or ylo == yhi:
            out += [("-", line) for line in x[xlo:xhi]] + [("+", line) for line in y[ylo:yhi]]
            continue
        a, b, c, d = _meeting(x[xlo:xhi], y[ylo:yhi])
        left.append((xlo + c, xhi, ylo + d, yhi))
        if c > a:
            left.append((xlo + a, -(xlo + c), 0, 0))
        left.append((xlo, xlo + a, ylo, ylo + b))
    return out


def sequence_difference(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """keys, pos, sign, line: the shortest edit script of two texts' lines, with lines kept (blank), gone (-) and new (+) (SET-02). Each pair of texts is a row.

    A task holds one pair's script and CHUNK characters of rows that go out, not the scripts of a whole batch.
    """
    rows = pairs.select(*keys, F.col(old).alias("_old"), F.col(new).alias("_new"))
    names = [*keys, "pos", "sign", "line"]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                x, y = batch.column("_old")[i].as_py() or "", batch.column("_new")[i].as_py() or ""
                for pos, (sign, line) in enumerate(shortest_script(x.split("\n"), y.split("\n"))):
                    held.append((i, pos, sign, line))
                    size += len(line) + 16
                    if size >= CHUNK:
                        yield _rows(batch, keys, names, held)
                        held, size = [], 0
            if held:
                yield _rows(batch, keys, names, held)

    return rows.mapInArrow(scripts, f"{kinds}, pos int, sign string, line string")


#: Characters of an edit script's rows that go out at once.
CHUNK = 1 << 20


def _rows(batch: pa.RecordBatch, keys: list[str], names: list[str], held: list[tuple]) -> pa.RecordBatch:
    at, pos, sign, line = zip(*held, strict=True)
    own = pa.array(at, pa.int32())
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in keys), pa.array(pos, pa.int32()), pa.array(sign, pa.string()), pa.array(line, pa.string())], names)


def dashboard(devices: DataFrame, interfaces: DataFrame) -> DataFrame:
    """what, name, n: devices by vendor and interfaces by status, over all rows (AGG-12)."""
    named = lambda df, what, c: df.groupBy(F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return named(devices, "vendor", "vendor").union(named(interfaces, "status", "status"))


def supported_types(rules: DataFrame) -> DataFrame:
    """vendor, types: how many kinds of output are understood (AGG-19). rules: vendor, kind."""
    return rules.groupBy("vendor").agg(F.count_distinct("kind").alias("types"))


def compare_fields(fields: DataFrame, vendors: list[str]) -> DataFrame:
    """field and a column for each vendor, with how that one describes it or the empty string (QRY-11). fields: vendor, field, description."""
    return fields.groupBy("field").pivot("vendor", vendors).agg(F.first("description")).na.fill("")


def inventory(devices: DataFrame, interfaces: DataFrame, cut_off: DataFrame) -> DataFrame:
    """line_no, line of a Markdown report: numbers, a table of devices, and those that nothing can replace (SNK-04).

    devices: id, hostname, vendor. cut_off: id. Each device is one row of text; nothing is collected.
    """
    said = lambda part, line: devices.sparkSession.createDataFrame([(part, line)], "part int, line string")
    number = lambda df, part, name: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), F.concat(F.lit(f"- {name}: "), "n").alias("line"))
    head = said(0, "# Inventory").union(number(devices, 1, "devices")).union(number(interfaces, 2, "interfaces")).union(said(3, "| id | host | vendor |"))
    rows = devices.select(F.lit(4).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", "id", "hostname", "vendor"), F.lit(" |")).alias("line"))
    return head.union(rows).union(cut_off.select(F.lit(5), F.concat(F.lit("- single point: "), "id"))).orderBy("part", "line")
