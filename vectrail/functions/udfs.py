"""User-defined functions: a registry, Arrow-batched scalar functions, aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class FunctionRegistry:
    """Named functions of a session. Bodies are Python callables on batches (pandas series) with a declared type."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.functions: dict[str, Callable[..., Column]] = {}

    def register(self, name: str, body: Callable, returns: str) -> Callable[..., Column]:
        if name in self.functions:
            raise ValueError(f"function {name} exists")
        udf = F.pandas_udf(body, returns)
        self.spark.udf.register(name, udf)
        self.functions[name] = udf
        return udf

    def call(self, name: str, *columns) -> Column:
        if name not in self.functions:
            raise KeyError(f"no function {name}")
        return self.functions[name](*columns)

    def unregister(self, name: str) -> None:
        del self.functions[name]
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    def exists(self, name: str) -> bool:
        return name in self.functions

    def names(self) -> list[str]:
        return sorted(self.functions)


def add_up() -> Callable[..., Column]:
    """Sum of its arguments, as an Arrow-batched function."""

    def body(*parts: pd.Series) -> pd.Series:
        return sum(parts[1:], parts[0].astype("float64"))

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return body(a, b)

    return F.pandas_udf(two, "double")


def geo_mean(x) -> Column:
    return F.exp(F.avg(F.ln(x)))


def register_ngrams(spark: SparkSession) -> None:
    """Table function ``word_ngrams(text, n)``: position and n-gram of every run of n words."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="position int, ngram string")
    class WordNgrams:
        def eval(self, text: str, n: int):
            words = (text or "").split()
            for i in range(len(words) - n + 1):
                yield i, " ".join(words[i : i + n])

    spark.udtf.register("word_ngrams", WordNgrams)
