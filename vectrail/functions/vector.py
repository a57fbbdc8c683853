"""Distances, similarities and element-wise arithmetic of vectors, as columns.

Everything is computed in double precision on the JVM. Vectors are arrays of float or double; of different lengths
they raise an error, as an analysis-time check can't see the lengths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of metrics and their aliases.
METRICS = {
    "cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "manhattan": "manhattan", "l1": "manhattan",
    "dot": "dot", "dot_product": "dot", "inner_product": "dot", "mips": "dot",
}


def as_column(vector) -> Column:
    """A column, a column's name, or a list of numbers as a literal."""
    if isinstance(vector, Column):
        return vector
    if isinstance(vector, str):
        return F.col(vector)
    return F.array(*(F.lit(float(x)) for x in vector))


def doubles(vector) -> Column:
    return as_column(vector).cast("array<double>")


def checked(a, b, result: Column) -> Column:
    """The result, or an error where dimensions differ."""
    a, b = as_column(a), as_column(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector dimensions differ")).cast("double")).otherwise(result)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return checked(a, b, total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda x: x * x)))


def squared_l2(a, b) -> Column:
    return checked(a, b, total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def manhattan(a, b) -> Column:
    return checked(a, b, total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))))


def cosine_similarity(a, b) -> Column:
    """0 where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def cosine(a, b, zero_norm: str = "match") -> Column:
    """Distance 1 - similarity. A vector without length has distance 0 (``match``) or 1 (``miss``)."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0 if zero_norm == "match" else 1.0)).otherwise(1 - dot(a, b) / length)


def distance(a, b, metric: str = "cosine") -> Column:
    """Lower is better for every metric; the dot product is negated."""
    kind = METRICS[metric.lower()]
    if kind == "dot":
        return -dot(a, b)
    return {"cosine": cosine, "euclidean": euclidean, "manhattan": manhattan}[kind](a, b)


def similarity(a, b, metric: str = "cosine") -> Column:
    """Higher is better; unequal lengths give 0 (or the largest double as a distance, hence similarity near 0)."""
    same = F.size(as_column(a)) == F.size(as_column(b))
    kind = METRICS[metric.lower()]
    if kind == "dot":
        return F.when(same, dot(a, b)).otherwise(0.0)
    if kind == "euclidean":
        return F.when(same, 1 / (1 + euclidean(a, b))).otherwise(0.0)
    return F.when(same, cosine_similarity(a, b)).otherwise(0.0)


def elementwise(a, b, op: str) -> Column:
    """add, sub, mul or div; division by 0 gives null."""
    ops = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: F.try_divide(x, y)}
    return F.zip_with(doubles(a), doubles(b), ops[op])


def normalized(a) -> Column:
    """Scaled to length 1; a vector without length stays as it is."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))), 1)
