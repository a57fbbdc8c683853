"""Fluent queries on a collection: vector search, field filters and their combinations, sorting, paging."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters
from .search import ranked, scored


@dataclass(frozen=True)
class Condition:
    """A leaf (``op`` with field and value) or ``and``, ``or``, ``not`` over others."""

    op: str
    field: str | None = None
    value: object = None
    parts: tuple = ()

    def column(self) -> Column:
        if self.op == "and":
            return filters.all_of(*(p.column() for p in self.parts))
        if self.op == "or":
            return filters.any_of(*(p.column() for p in self.parts))
        if self.op == "not":
            return ~self.parts[0].column()  # leaves are never null, so this is the complement
        return filters.predicate(self.field, self.op, self.value)

    def check(self) -> None:
        if self.op in ("and", "or", "not"):
            if not self.parts:
                raise ValueError(f"{self.op} needs conditions")
            for part in self.parts:
                part.check()
        elif not self.field:
            raise ValueError("a filter needs a field")


def where(field: str, op: str, value) -> Condition:
    return Condition(op, field, value)


def all_of(*parts: Condition) -> Condition:
    return Condition("and", parts=parts)


def any_of(*parts: Condition) -> Condition:
    return Condition("or", parts=parts)


def not_(part: Condition) -> Condition:
    return Condition("not", parts=(part,))


@dataclass(frozen=True)
class QueryBuilder:
    """Immutable; every method returns a new builder. ``run`` gives ``document_id, document, score, rank``, lazily."""

    collection: str
    conditions: tuple[Condition, ...] = ()
    vector: tuple[float, ...] | None = None
    vector_field: str = "embedding"
    metric: str = "cosine"
    threshold: float | None = None
    sort_field: str | None = None
    ascending: bool = True
    page_size: int = 10
    start: int = 0
    with_documents: bool = True
    with_scores: bool = True
    extra: dict = field(default_factory=dict)

    def near(self, vector, field: str = "embedding", metric: str = "cosine", threshold: float | None = None) -> QueryBuilder:
        return replace(self, vector=tuple(map(float, vector)), vector_field=field, metric=metric, threshold=threshold)

    def filter(self, field: str, op: str, value) -> QueryBuilder:
        return self.where(where(field, op, value))

    def where(self, condition: Condition) -> QueryBuilder:
        return replace(self, conditions=(*self.conditions, condition))

    def sort(self, field: str, ascending: bool = True) -> QueryBuilder:
        return replace(self, sort_field=field, ascending=ascending)

    def limit(self, n: int) -> QueryBuilder:
        return replace(self, page_size=n)

    def offset(self, n: int) -> QueryBuilder:
        return replace(self, start=n)

    def include(self, documents: bool = True, scores: bool = True) -> QueryBuilder:
        return replace(self, with_documents=documents, with_scores=scores)

    def check(self) -> None:
        if not self.collection:
            raise ValueError("a query needs a collection")
        if self.page_size <= 0:
            raise ValueError("the limit must be positive")
        if self.start < 0:
            raise ValueError("the offset can't be negative")
        if self.vector is None and not self.conditions:
            raise ValueError("a query needs a vector or conditions")
        for condition in self.conditions:
            condition.check()

    def run(self, rows: DataFrame, id_col: str = "id") -> DataFrame:
        self.check()
        if self.conditions:
            rows = rows.where(filters.all_of(*(c.column() for c in self.conditions)))
        document = F.struct(*rows.columns).alias("document")
        keys = [F.col(id_col).alias("document_id")]
        if self.sort_field:
            keys.append(F.col(self.sort_field).alias("_sort"))
        if self.vector is not None:
            rows = scored(rows, list(self.vector), self.vector_field, self.metric)
            if self.threshold is not None:
                rows = rows.where(F.col("score") <= self.threshold)
        else:
            rows = rows.withColumn("score", F.lit(None).cast("double"))
        rows = rows.select(*keys, document if self.with_documents else F.lit(None).alias("document"), "score")
        if self.sort_field:
            order = [F.col("_sort").asc_nulls_first() if self.ascending else F.col("_sort").desc_nulls_last()]
        else:
            order = [F.col("score").asc_nulls_last()]
        page = ranked(rows, [*order, F.col("document_id").asc()], self.page_size, self.start).drop("_sort")
        return page if self.with_scores else page.withColumn("score", F.lit(None).cast("double"))
