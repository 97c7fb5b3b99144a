"""All queries of the reference's own operators."""

from __future__ import annotations

from . import elementwise, grouped, positional, workloads  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
