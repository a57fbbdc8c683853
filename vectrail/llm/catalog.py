"""The queries of this subpackage with their SQL twins."""

from __future__ import annotations

from . import extract, lines, mixing, near_duplicates, neighbours, packing, quality, secrets, suffixes, warc

MODULES = (secrets, extract, quality, neighbours, suffixes, near_duplicates, warc, mixing, lines, packing)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
