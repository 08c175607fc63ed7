"""The named queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from ridgeline import log_queries  # noqa: F401  # adds its queries
from ridgeline.queries import FOUND, SQL, Query


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
