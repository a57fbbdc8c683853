"""Log and metric analytics over a table of entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(values, p: float) -> Column:
    """Element ``round(p * (n - 1))`` of the sorted values, exact. The array holds one group's numbers; for groups
    without bound use ``nearest_rank_by``."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, (F.round(p * (F.size(ordered) - 1)) + 1).cast("int"))


def nearest_rank_by(rows: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """The same without gathering a group: distinct values are counted before they are dealt, and the running count
    finds the element. Names are ``p50``, ``p99`` and so on."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum("_n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(by))
    at = lambda p: F.round(p * (F.col("_all") - 1)) + 1
    return counts.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") >= at(p), F.col(value))).alias(f"p{round(p * 100)}") for p in ps))


def rate(condition: Column) -> Column:
    """Share of rows that meet the condition; 0 without rows."""
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))


def log_filter(rows: DataFrame, levels=None, components=None, exclude_components=None, text=None, pattern=None, since=None, until=None, level_col="event_type", component_col="user_id", text_col="props", time_col="ts") -> DataFrame:
    """Entries that meet every condition given. Times are inclusive."""
    if levels:
        rows = rows.where(F.col(level_col).isin(list(levels)))
    if components:
        rows = rows.where(F.col(component_col).isin(list(components)))
    if exclude_components:
        rows = rows.where(~F.col(component_col).isin(list(exclude_components)))
    if text:
        rows = rows.where(F.lower(text_col).contains(text.lower()))
    if pattern:
        rows = rows.where(F.col(text_col).rlike(pattern))
    if since is not None:
        rows = rows.where(F.col(time_col) >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.where(F.col(time_col) <= F.lit(until).cast("timestamp_ntz"))
    return rows


def page(rows: DataFrame, order: Sequence, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) with the number of all rows and of pages."""
    total = rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def ema(rows: DataFrame, key: str, order: Sequence[str], value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average along each key's order, the first value as its start."""
    fold = lambda acc, x: F.when(acc.isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * acc)
    entry = F.struct(*order, F.col(value).cast("double").alias("v"))
    return rows.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(entry)), F.lit(None).cast("double"), fold).alias("ema"))


def histogram(rows: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """``bucket, n``: equal widths; bucket 0 lies below, ``buckets + 1`` from ``high`` on."""
    number = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(buckets))
    return rows.groupBy(number.alias("bucket")).agg(F.count("*").alias("n"))


def deterministic_sample(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Rows whose hashed key falls below the share; the same rows each time."""
    return rows.where(F.pmod(F.xxhash64(key), F.lit(100)) < percent)


def sampled_by(rows: DataFrame, column: str, shares: dict, seed: int = 0) -> DataFrame:
    """A share of each level's rows."""
    return rows.sampleBy(column, shares, seed)


#: Limits of the metric alerts.
ALERTS = {"cpu": 90.0, "memory": 90.0, "disk": 90.0, "latency_ms": 1000.0, "failure_rate": 0.05}


def alerts(metrics: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """``name, value, limit`` of every metric (columns of a row) over its limit; without traffic the failure rate is 0."""
    limits = limits or ALERTS
    entries = F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("value"), F.lit(v).alias("limit")) for k, v in limits.items()))
    return metrics.select(F.explode(entries).alias("a")).select("a.*").where("value > `limit`")


def allowed(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """``requests`` (role, resource, action) with ``allowed``; a grant's resource or action ``*`` matches all."""
    match = (F.col("r.role") == F.col("g.role")) & ((F.col("g.resource") == "*") | (F.col("g.resource") == F.col("r.resource"))) & ((F.col("g.action") == "*") | (F.col("g.action") == F.col("r.action")))
    yes = requests.alias("r").join(grants.alias("g"), match, "left_semi").distinct()
    return requests.join(yes.withColumn("allowed", F.lit(True)), ["role", "resource", "action"], "left").fillna(False, ["allowed"])
