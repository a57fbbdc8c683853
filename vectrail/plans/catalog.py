"""All queries of the library with their SQL twins."""

from __future__ import annotations

from . import analytics, changes, documents, relational, scalars, vectors  # noqa: F401  entered on import
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
