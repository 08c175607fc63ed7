"""Names, sizes and times as texts (FN-19, 21, 25, TBL-02, 03, AGG-18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute(at: Column) -> Column:
    """FN-19."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def byte_size(n: Column) -> Column:
    """B, KB or MB with one digit behind the point (FN-21)."""
    return F.when(n < 1024, F.format_string("%dB", n)).when(n < 1 << 20, F.format_string("%.1fKB", n / 1024.0)).otherwise(F.format_string("%.1fMB", n / 1048576.0))


def column_name(header: Column) -> Column:
    """A header's word in snake case: letters and digits lower-cased, the rest one underscore, none at the ends (TBL-02)."""
    return F.lower(F.regexp_replace(F.regexp_replace(header, r"[^\p{L}\p{Nd}]+", "_"), "^_+|_+$", ""))


def group_names(pattern: Column) -> Column:
    """Names of the named groups of a pattern or program, each once, in order (TBL-03)."""
    return F.array_distinct(F.regexp_extract_all(pattern, F.lit(r"\(\?P<([^>]+)>"), F.lit(1)))


def _bare(command: Column) -> Column:
    """A command without its verb and its placeholders."""
    plain = F.regexp_replace(F.lower(F.trim(command)), r"^(?:display )?(?:show )?(?:dis )?(?:sh )?", "")
    return F.regexp_replace(plain, r"\{[^}]*\}", "")


def identifier(command: Column) -> Column:
    """A command's words, capitalised and joined (FN-25)."""
    parts = F.filter(F.split(_bare(command), "[ _-]"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), "")


def generated_type(vendor: Column, command: Column) -> Column:
    """The type of a command that a rule of its own reads (FN-25, CLS-05)."""
    stem = F.regexp_replace(F.regexp_replace(F.trim(_bare(command)), r"[\s-]+", "_"), "_+$", "")
    return F.concat(F.lit("generated:"), vendor, F.lit(":"), stem)


def source_group(source: Column) -> Column:
    """What stands before the first colon, unless that comes first or is absent (AGG-18)."""
    return F.when(F.instr(source, ":") > 1, F.substring_index(source, ":", 1)).otherwise(source)
