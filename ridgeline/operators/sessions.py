"""Session logs: prompts, blocks of command and output, and what follows from them (SPL, SRC-05)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import classify, commands
from ridgeline.operators.ordering import BROADCAST
from ridgeline.operators.running import running_last, running_sum
from ridgeline.plans.program import is_blank, let
from ridgeline.session import cut

# Time stamps before a line, and prompts by vendor.
STAMP = r"^\d{4}-\d{2}-\d{2}[-T ]\d{2}[-:]\d{2}[-:]\d{2}[:.][\t\n\f\r ]*"
LOOSE_STAMP = r"^\d{4}-\d{2}-\d{2}[-T ]\d{2}[-:]\d{2}[-:]\d{2}[:.]?[\t\n\f\r ]*"
HOST = "([A-Za-z][A-Za-z0-9._-]*)"
#: A prompt's host, by vendor; the first vendor whose pattern gives a host and a command counts.
PROMPTS = {
    "huawei": (r"^<([^@$~/ \[\]>]{3,})>", r"^\[([^@$~ \]]+)\]"),
    "cisco": (rf"^{HOST}(?:\([^)]*\))?#", rf"^RP/\d+/[A-Z0-9]+/CPU\d+:{HOST}#"),
    "juniper": (rf"^[a-zA-Z][a-zA-Z0-9._-]*@{HOST}[>#]",),
}


def unstamped(line: Column, strict: bool = False) -> Column:
    """A line without its leading time stamp; strict: only one with a `:` or `.` behind it."""
    return F.regexp_replace(line, STAMP if strict else LOOSE_STAMP, "")


def stamp(line: Column, strict: bool = False) -> Column:
    """The time of a line's stamp; null without one."""
    raw = F.regexp_replace(F.regexp_extract(line, STAMP if strict else LOOSE_STAMP, 0), r"[:. \t]+$", "")
    digits = F.regexp_replace(raw, r"[-T :]", "")
    return F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMddHHmmss"))


def prompt(line: Column) -> Column:
    """host, vendor and command of a prompt line, as a struct; null for other lines."""
    found = []
    for vendor, patterns in PROMPTS.items():
        for p in patterns:
            host = F.regexp_extract(line, p, 1)
            rest = F.substring(line, F.instr(line, host).cast("int") + F.length(host), F.length(line))
            command = None
            for mark in (">", "#", "]"):
                at = F.instr(rest, mark)
                text = F.when(at > 0, commands.trim(F.substring(rest, at + 1, F.length(rest))))
                command = text if command is None else F.coalesce(command, text)
            found.append(F.when((host != "") & (command != ""), F.struct(host.alias("hostname"), F.lit(vendor).alias("vendor"), command.alias("command"))))
    return F.coalesce(*found)


def _maybe_prompt(line: Column) -> Column:
    """Whether a line begins as one of PROMPTS, with or without a stamp: one pattern, where prompt() tries each."""
    return line.rlike(f"^(?:{LOOSE_STAMP[1:]})?(?:{'|'.join(p[1:] for patterns in PROMPTS.values() for p in patterns)})")


def log_blocks(text: Column, complete_only: bool = False) -> Column:
    """block_no's structs of hostname, vendor, command, output, captured_at: what lies between the prompts of a log, as an array."""

    def blocks(lines: Column) -> Column:
        near = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: _maybe_prompt(s["x"]))
        seen = F.filter(F.transform(near, lambda s: F.struct(s["i"].alias("i"), prompt(unstamped(F.regexp_replace(s["x"], r"[\r \t]+$", ""))).alias("p"), stamp(s["x"]).alias("t"))), lambda x: x["p"].isNotNull())

        def outputs(heads: Column) -> Column:
            def one(h: Column, k: Column) -> Column:
                end = F.coalesce(F.get(heads, k + 1)["i"], F.size(lines))
                body = F.slice(lines, h["i"] + 2, end - h["i"] - 1)
                # Where no line has a stamp or a \r, there is nothing to take from any.
                plain = let(F.array_join(body, "\n"), lambda x: F.when(x.contains("\r") | x.rlike(r"(?m)^\d{4}-\d{2}-"), F.array_join(F.transform(body, lambda y: unstamped(F.regexp_replace(y, r"\r+$", ""))), "\n")).otherwise(x))
                return F.struct(h["p"]["hostname"].alias("hostname"), h["p"]["vendor"].alias("vendor"), h["p"]["command"].alias("command"), F.regexp_replace(plain, r"[\n\r \t]+$", "").alias("output"), h["t"].alias("captured_at"))

            return F.transform(heads, one)

        return let(seen, outputs)

    array = let(F.split(F.coalesce(text, F.lit("")), "\n", -1), blocks)
    return let(array, lambda b: F.slice(b, F.lit(1), F.greatest(F.size(b) - 1, F.lit(0)))) if complete_only else array


def split_log(df: DataFrame, text_col: str, keys: list[str], complete_only: bool = False) -> DataFrame:
    """keys, block_no, hostname, vendor, command, output, captured_at: what lies between prompts.

    A log's lines are an array in its own row, so nothing is shuffled. complete_only leaves out the
    last block, which may still grow (STR-02).
    """
    return df.select(*keys, F.posexplode(log_blocks(F.col(text_col), complete_only)).alias("block_no", "b")).select(*keys, "block_no", "b.*")


def split_ranges(spark: SparkSession, path: str) -> DataFrame:
    """file and the columns of split_log() of log files of any size, each read in byte ranges by as many tasks (SPL-05, SRC-01).

    A task joins the lines of its range to blocks as it reads them, and these are kept once in the shared folder.
    Prompts are counted within each range; what the ranges before hold, one row for a range, is added up, so
    every block knows its number wherever a file is cut. Only what may go on in another range, two parts of each, is shuffled.
    A block's lines meet in one row, as they do in its output; no file does.
    """
    value = F.col("value")
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    p = F.when(_maybe_prompt(value), let(unstamped(F.regexp_replace(value, r"[\r \t]+$", "")), prompt))  # few lines are: the rest of the row's code stays small
    line = F.when(value.contains("\r") | value.rlike(r"^\d{4}-"), unstamped(F.regexp_replace(value, r"\r+$", ""))).otherwise(value)
    lines = read.withColumn("p", p).select("file", "start", "p", F.when(F.col("p").isNotNull(), F.unix_micros(stamp(value))).alias("time"), line.alias("body"))
    parts = cut(lines.mapInArrow(_parts, "file string, start long, own int, last boolean, p struct<hostname:string,vendor:string,command:string>, time long, body string"))
    held = parts.groupBy("file", "start").agg(F.max("own").alias("_n"))
    before = cut(held.select("file", "start", (F.sum("_n").over(Window.partitionBy("file").orderBy("start")) - F.col("_n")).alias("_before")))  # a row for each range
    before = F.broadcast(before) if before.count() <= BROADCAST else before  # else outputs would be shuffled for it
    placed = parts.join(before, ["file", "start"]).withColumn("block_no", (F.col("_before") + F.col("own") - 1).cast("int")).where("block_no >= 0")
    open_ = F.col("last") | (F.col("own") == 0)
    cut_up = placed.where(open_).groupBy("file", "block_no").agg(F.array_sort(F.collect_list(F.struct("start", "p", "time", "body"))).alias("h")).withColumn("head", F.element_at("h", 1))
    rows = placed.where(~open_).select("file", "block_no", "p", "time", "body").union(cut_up.select("file", "block_no", "head.p", "head.time", F.array_join("h.body", "\n")))
    output = F.regexp_replace(F.coalesce("body", F.lit("")), r"[\n\r \t]+$", "")
    return rows.select("file", "block_no", "p.hostname", "p.vendor", "p.command", output.alias("output"), F.timestamp_micros("time").alias("captured_at"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's lines, in order, as parts of blocks: own is the number of prompts up to it, 0 for what is before the first; last: the range's
    last part; body: its lines but for the prompt, null if there are none."""
    part, texts, schema = None, [], None  # the part that is open, and its lines

    def closed(last: bool) -> dict:
        return part | {"last": last, "body": "\n".join(texts) if texts else None}

    for batch in batches:
        n, done = len(batch), []
        if not n:
            continue
        file, start, p, time, body = batch.columns
        schema = pa.schema([("file", file.type), ("start", start.type), ("own", pa.int32()), ("last", pa.bool_()), ("p", p.type), ("time", time.type), ("body", body.type)])
        heads = set(np.flatnonzero(p.is_valid().to_numpy(zero_copy_only=False)).tolist())
        moved = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
        ranges = {0, *(np.flatnonzero(moved) + 1).tolist()}  # where another range may begin
        edges = sorted(ranges | heads)
        for i, end in zip(edges, [*edges[1:], n], strict=True):
            at = {"file": file[i].as_py(), "start": start[i].as_py()}
            if i in ranges and (part is None or at != {k: part[k] for k in at}):
                if part is not None:
                    done.append(closed(True))
                part, texts = at | {"own": 0, "p": None, "time": None}, []
            if i in heads:
                if part["own"] or texts:
                    done.append(closed(False))
                part, texts = at | {"own": part["own"] + 1, "p": p[i].as_py(), "time": time[i].as_py()}, []
            first = i + (i in heads)
            if end > first:
                texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, end - first], pa.int32()), body[first:end]), "\n")[0].as_py())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if part is not None:
        yield pa.RecordBatch.from_pylist([closed(True)], schema)


def reclassified(blocks: DataFrame) -> DataFrame:
    """Blocks with vendor h3c for every host, whatever its case, that says so in the first ten lines of an output (SPL-07)."""
    head = F.split(F.substring_index("output", "\n", 10), "\n", -1)
    says = F.exists(head, lambda x: F.lower(commands.trim(x)).startswith("version 7.") | F.lower(x).contains("mdc admin id"))
    ours = cut(blocks.where((F.col("vendor") == "huawei") & says).select(F.lower("hostname").alias("_host")).distinct())
    n = ours.count()
    if not n:
        return blocks
    ours = F.broadcast(ours) if n <= BROADCAST else ours  # else outputs would be shuffled for it
    out = blocks.join(ours, F.lower("hostname") == F.col("_host"), "left")
    return out.withColumn("vendor", F.when(F.col("_host").isNotNull() & (F.col("vendor") == "huawei"), "h3c").otherwise(F.col("vendor"))).drop("_host")


def classified(blocks: DataFrame) -> DataFrame:
    """Blocks of other than help queries, with cmd_type, command_norm and category (SPL-08, 10, 11, 15)."""
    vendor, command = F.col("vendor"), F.col("command")
    norm = commands.strip_args(commands.normalise(vendor, command))
    kept = blocks.where(~F.regexp_replace(command, r"\s+$", "").endswith("?"))
    return kept.withColumns({"cmd_type": classify.command_type(vendor, command), "command_norm": norm}).withColumn("category", commands.category(F.col("command_norm")))


def unknown_outputs(blocks: DataFrame) -> DataFrame:
    """vendor, command_norm, content_hash with first and last time and occurrences, for outputs of unknown commands that say something (AGG-15)."""
    vendor, command, output = F.col("vendor"), F.col("command"), F.col("output")
    kept = blocks.where((F.col("cmd_type") == "unknown") & ~is_blank(output) & ~commands.is_control(vendor, command) & ~commands.is_help(output) & ~commands.is_error(output))
    kept = kept.withColumn("content_hash", commands.content_hash(output))
    return kept.groupBy("vendor", "command_norm", "content_hash").agg(F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"), F.count("*").alias("occurrence_count"))


def longest_outputs(blocks: DataFrame, order: str) -> DataFrame:
    """One block for each vendor and normalised command: that with the longest output, the first of equal ones (SPL-09)."""
    best = F.max_by(F.struct("command", "output"), F.struct(F.length("output"), -F.col(order)))
    found = blocks.groupBy("vendor", "command_norm").agg(best.alias("b"), F.min(order).alias("first_seen_at"), F.count("*").alias("blocks"))
    return found.select("vendor", "command_norm", "b.command", "b.output", "first_seen_at", "blocks")


def marked(blocks: DataFrame) -> DataFrame:
    """Blocks, none left out, with command_norm, category, cmd_type and what each is: has_output, is_control, is_help,
    is_error, and selected, where a rule of its own is worth making (SPL-09)."""
    vendor, command = F.col("vendor"), F.col("command")
    said = F.regexp_replace(F.coalesce("output", F.lit("")), r"^\s+|\s+$", "")
    norm = commands.normalise(vendor, command)
    full = said != ""
    out = blocks.withColumns({"command_norm": commands.strip_args(norm), "category": commands.category(norm), "cmd_type": classify.command_type(vendor, command), "has_output": full, "is_control": commands.is_control(vendor, command), "is_help": full & commands.is_help(said), "is_error": full & commands.is_error(said)})
    return out.withColumn("selected", F.col("has_output") & ~F.col("is_control") & ~F.col("is_help") & ~F.col("is_error") & (F.col("cmd_type") == "unknown"))


def analysed(blocks: DataFrame, order: str) -> DataFrame:
    """marked() blocks, one for each vendor and pattern: that with the longest output, the first of equal ones; selected if
    any is; place is the first one's (SPL-09, SRC-14)."""
    keep = ["command", "output", "category", "cmd_type", "has_output", "is_control", "is_help", "is_error"]
    best = F.max_by(F.struct(*keep), F.struct(F.length(F.coalesce("output", F.lit(""))), -F.col(order)))
    found = marked(blocks).groupBy("vendor", "command_norm").agg(best.alias("b"), F.bool_or("selected").alias("selected"), F.min(order).alias("place"))
    return found.select("vendor", "command_norm", "b.*", "selected", "place")


def raw_config(text: Column) -> Column:
    """host, vendor and text of a configuration without prompts, from its first 30 lines; null if there is no sysname (SRC-05)."""

    def judge(head: Column) -> Column:
        host = F.regexp_extract(F.get(F.filter(head, lambda x: x.rlike(r"^\s*sysname\s+\S")), F.lit(0)), r"^\s*sysname\s+(\S+)", 1)
        low = F.lower(F.array_join(head, "\n"))
        vendor = F.when(low.contains("version 7.") | low.contains("mdc admin id"), "h3c").otherwise("huawei")
        body = F.when(F.lower(commands.trim(F.get(head, F.lit(0)))).startswith("dis"), F.regexp_replace(text, r"\A[^\n]*\n", "")).otherwise(text)
        return F.when(host.isNotNull() & (host != ""), F.struct(host.alias("hostname"), vendor.alias("vendor"), body.alias("config")))

    return let(F.slice(F.split(text, "\n", -1), 1, 30), judge)


def sessions(df: DataFrame, keys: list[str], order: list[str], opens: Column) -> DataFrame:
    """df with session_no: rows from one that opens a session to the next; 0 before the first."""
    return running_sum(df, keys, order, opens.cast("long"), "session_no")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value, null left out, at or before each row (PAR-02, 03, 15)."""
    return running_last(df, keys, order, value, name)
