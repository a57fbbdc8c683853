"""Predicates on document fields, and their combination as sets of ids.

A null or missing field matches no operator, negated ones included. Ordered operators compare numbers with numbers and
strings with strings; ``contains`` looks for a substring, or an element where the field is an array.
"""

from __future__ import annotations

from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FilterOperator(Enum):
    EQ = "eq"
    NE = "ne"
    GT = "gt"
    GTE = "gte"
    LT = "lt"
    LTE = "lte"
    CONTAINS = "contains"
    NOT_CONTAINS = "not_contains"
    IN = "in"
    NOT_IN = "not_in"


def predicate(field, op: FilterOperator | str, value, is_array: bool = False) -> Column:
    """True or false, never null."""
    x = F.col(field) if isinstance(field, str) else field
    op = FilterOperator(op)
    match op:
        case FilterOperator.EQ:
            out = x == value
        case FilterOperator.NE:
            out = x != value
        case FilterOperator.GT:
            out = x > value
        case FilterOperator.GTE:
            out = x >= value
        case FilterOperator.LT:
            out = x < value
        case FilterOperator.LTE:
            out = x <= value
        case FilterOperator.CONTAINS | FilterOperator.NOT_CONTAINS:
            out = F.array_contains(x, value) if is_array else x.contains(value)
            out = ~out if op is FilterOperator.NOT_CONTAINS else out
        case _:
            if not isinstance(value, (list, tuple, set)):
                raise ValueError(f"{op.value} needs a list")
            out = x.isin(list(value))
            out = ~out if op is FilterOperator.NOT_IN else out
    return F.coalesce(out, F.lit(False)) & x.isNotNull()


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts)


def intersection(legs: list[DataFrame], id_col: str = "document_id") -> DataFrame:
    """Rows of the first leg whose id is in all others; the score is the first leg's."""
    return reduce(lambda a, b: a.join(b.select(id_col), id_col, "left_semi"), legs)


def union(legs: list[DataFrame], id_col: str = "document_id") -> DataFrame:
    """Every id of any leg once; the last leg that has it gives the row."""
    tagged = reduce(DataFrame.unionByName, [leg.withColumn("_leg", F.lit(i)) for i, leg in enumerate(legs)])
    rest = [c for c in tagged.columns if c not in (id_col, "_leg")]
    if not rest:
        return tagged.select(id_col).distinct()
    last = tagged.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.col("_leg")).alias("_row"))
    return last.select(id_col, *(F.col(f"_row.{c}").alias(c) for c in rest))


def complement(everything: DataFrame, leg: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Rows whose id the leg doesn't have, rows with null fields included."""
    return everything.join(leg.select(id_col), id_col, "left_anti")
