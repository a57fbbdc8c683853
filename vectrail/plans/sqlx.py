"""SQL beyond Spark's: ``ANN SEARCH WITH (...)`` and the type ``VECTOR(n)``."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.search import top_k

_ANN = re.compile(r"^\s*(?:ANN|VECTOR)\s+SEARCH\s+WITH\s*\((.*)\)\s*;?\s*$", re.I | re.S)
_OPTION = re.compile(r"\s*(\w+)\s*=\s*(\[[^\]]*\]|'[^']*'|[^,\s]+)\s*(?:,|$)", re.S)
_VECTOR = re.compile(r"\bVECTOR\s*\(\s*(\d+)\s*\)", re.I)


@dataclass(frozen=True)
class AnnStatement:
    query_vector: tuple[float, ...]
    column: str = "embedding"
    collection: str | None = None
    k: int = 10
    ef_search: int | None = None
    metric: str = "cosine"
    threshold: float | None = None


def parse_ann(statement: str) -> AnnStatement:
    found = _ANN.match(statement)
    if not found:
        raise ValueError("not an ANN SEARCH statement")
    body, at, options = found[1].strip(), 0, {}
    while at < len(body):
        m = _OPTION.match(body, at)
        if not m:
            raise ValueError(f"option expected at {body[at:at + 20]!r}")
        options[m[1].lower()] = m[2].strip("'")
        at = m.end()
    if "query_vector" not in options:
        raise ValueError("QUERY_VECTOR is missing")
    k = int(options.get("limit_k", 10))
    if k <= 0:
        raise ValueError("LIMIT_K must be positive")
    numbers = tuple(float(x) for x in options["query_vector"].strip("[]").split(",") if x.strip())
    known = {"query_vector", "column", "col", "collection", "limit_k", "ef_search", "metric", "threshold"}
    if set(options) - known:
        raise ValueError(f"unknown options: {sorted(set(options) - known)}")
    return AnnStatement(numbers, options.get("column", options.get("col", "embedding")), options.get("collection"), k, int(options["ef_search"]) if "ef_search" in options else None, options.get("metric", "cosine").lower(), float(options["threshold"]) if "threshold" in options else None)


def ann_search(spark: SparkSession, statement: str, lookup: Callable[[str], DataFrame] | None = None, id_col: str = "id") -> DataFrame:
    """Run an ANN statement, exactly, on a table or on what ``lookup`` gives for the collection's name."""
    s = parse_ann(statement)
    if not s.collection:
        raise ValueError("COLLECTION is missing")
    rows = (lookup or spark.table)(s.collection)
    return top_k(rows, s.query_vector, s.k, s.column, id_col, s.metric, s.threshold)


def run_sql(spark: SparkSession, statement: str, lookup=None, id_col: str = "id") -> DataFrame:
    """Spark SQL, with ANN statements, ``VECTOR(n)`` columns and EXPLAIN of an ANN statement."""
    explain = re.match(r"\s*EXPLAIN\s+(.*)$", statement, re.I | re.S)
    if explain and _ANN.match(explain[1]):
        plan = ann_search(spark, explain[1], lookup, id_col)
        return spark.createDataFrame([(plan._jdf.queryExecution().toString(),)], "plan string")
    if _ANN.match(statement):
        return ann_search(spark, statement, lookup, id_col)
    return spark.sql(translate(statement))


def translate(statement: str) -> str:
    """``VECTOR(n)`` as an array of float whose size is checked where rows are written (``Collection``)."""
    out = _VECTOR.sub("ARRAY<FLOAT>", statement)
    if re.match(r"\s*CREATE\s+TABLE\b", out, re.I) and not re.search(r"\bUSING\b", out, re.I):
        out = out.rstrip().rstrip(";") + " USING parquet"
    return re.sub(r"\bINTEGER\b", "BIGINT", out, flags=re.I) if re.match(r"\s*CREATE\s+TABLE\b", out, re.I) else out
