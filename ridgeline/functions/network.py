"""Columns over IPv4 addresses, masks and prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.plans.program import let

ADDRESS = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def to_long(ip: Column) -> Column:
    """An address as a number; null if it is none."""
    parts = F.transform(F.regexp_extract_all(F.when(ip.rlike(ADDRESS), ip), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    # A part above 255 makes the whole -1 and stays so.
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: F.when((a < 0) | (x > 255), -1).otherwise(a * 256 + x))
    return F.nullif(n, F.lit(-1).cast("long"))


def to_text(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def mask_length(mask: Column) -> Column:
    """A prefix length of `30` or `255.255.255.252`; null for others."""
    plain = F.when(mask.rlike(r"^\d{1,2}$") & (mask.try_cast("int") <= 32), mask.try_cast("int"))
    bits = lambda n: F.lpad(F.bin(n), 32, "0")
    return F.coalesce(plain, let(to_long(mask), lambda n: F.when(bits(n).rlike("^1*0*$"), F.length(F.replace(bits(n), F.lit("0"), F.lit(""))))))


def network(n: Column, length: Column) -> Column:
    """The network's number."""
    step = F.pow(F.lit(2.0), (F.lit(32) - length).cast("double")).cast("long")
    return n - F.pmod(n, step)


def subnet(ip: Column, mask: Column) -> Column:
    """`network/length`, or null if address or mask are none (FN-11)."""
    both = F.struct(to_long(ip).alias("n"), mask_length(mask).alias("len"))
    return let(both, lambda x: F.when(x["n"].isNotNull() & x["len"].isNotNull(), F.concat(to_text(network(x["n"], x["len"])), F.lit("/"), x["len"].cast("string"))))


def dotted_mask(length: Column) -> Column:
    """255.255.255.252 for 30 (FN-12)."""
    return to_text(F.lit((1 << 32) - 1) - (F.pow(F.lit(2.0), (F.lit(32) - length).cast("double")).cast("long") - 1))
