"""Scans of stored tables (SRC-06..11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotFound(LookupError):
    """A row that must be there is not."""


def scan(df: DataFrame, equal: dict[str, object] | None = None, like: dict[str, str] | None = None, order: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows that meet the predicates that are given; None and the empty string ask nothing (SRC-11, FN-02, TOPK-01, 02)."""
    for c, value in (equal or {}).items():
        if value is not None and value != "":
            df = df.where(F.col(c) == F.lit(value))
    for c, part in (like or {}).items():
        if part:
            df = df.where(F.lower(c).contains(part.lower()))
    if order:
        df = df.orderBy(*(F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order))
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def point(df: DataFrame, key: str, value: object):
    """The row of a key (SRC-07)."""
    row = df.where(F.col(key) == F.lit(value)).first()
    if row is None:
        raise NotFound(f"{key} = {value!r}")
    return row
