"""Log and metric analytics on events: the type is the level (error; signup stands for warning), the user the component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..streaming import windows as W
from ..tables import table
from .registry import query

C = F.col


def _is_error():
    return C("event_type") == "error"


def _is_warning():
    return C("event_type") == "signup"


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id")
def log_counts(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("SELECT round(coalesce(avg((event_type = 'error')::INT), 0), 6) AS error_rate, round(coalesce(avg((event_type = 'signup')::INT), 0), 6) AS warning_rate FROM events")
def log_error_rate(spark, d) -> DataFrame:
    return table(spark, d, "events").agg(F.round(A.rate(_is_error()), 6).alias("error_rate"), F.round(A.rate(_is_warning()), 6).alias("warning_rate"))


def _rank_sql(p: float) -> str:
    return f"list_sort(list(value))[round({p} * (count(*) - 1))::INT + 1]"


@query(f"""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, {_rank_sql(.5)} AS p50, {_rank_sql(.95)} AS p95, {_rank_sql(.99)} AS p99, round(avg((user_id % 7 = 0)::INT), 6) AS failure_rate,
round(count(*) / date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts)))::DOUBLE, 9) AS per_second FROM events GROUP BY event_type""")
def latency_percentiles(spark, d) -> DataFrame:
    rows = table(spark, d, "events")
    second = lambda f: F.unix_timestamp(F.date_trunc("second", f("ts")).cast("timestamp"))
    plain = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(A.rate(C("user_id") % 7 == 0), 6).alias("failure_rate"), F.round(F.count("*") / (second(F.max) - second(F.min)), 9).alias("per_second"))
    return plain.join(A.nearest_rank_by(rows, ["event_type"], "value", [0.5, 0.95, 0.99]), "event_type")


@query("SELECT props AS message, count(*) AS n FROM events GROUP BY props ORDER BY n DESC, message LIMIT 10")
def top_messages(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(C("props").alias("message")).agg(F.count("*").alias("n")).orderBy(C("n").desc(), "message").limit(10)


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings, round(max(value), 6) AS slowest,
CASE WHEN count(*) FILTER (event_type = 'error') * 4 > count(*) THEN 'unhealthy' WHEN count(*) FILTER (event_type = 'error') * 10 > count(*) THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY user_id""")
def component_health(spark, d) -> DataFrame:
    errors = F.count_if(_is_error())
    status = F.when(errors * 4 > F.count("*"), "unhealthy").when(errors * 10 > F.count("*"), "degraded").otherwise("healthy")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), errors.alias("errors"), F.count_if(_is_warning()).alias("warnings"), F.round(F.max("value"), 6).alias("slowest"), status.alias("status"))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.3 * x + 0.7 * a), 6) AS ema FROM events GROUP BY user_id")
def ema_duration(spark, d) -> DataFrame:
    return A.ema(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("ema", 6).alias("ema"))


@query("SELECT time_bucket(INTERVAL '1 minute', ts) AS minute, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings FROM events GROUP BY 1")
def log_buckets(spark, d) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 minute").alias("w"))
    return rows.agg(F.count("*").alias("n"), F.count_if(_is_error()).alias("errors"), F.count_if(_is_warning()).alias("warnings")).select(C("w.start").alias("minute"), "n", "errors", "warnings")


@query("""SELECT event_id FROM events WHERE event_type IN ('error', 'signup') AND user_id NOT IN (1, 2) AND contains(lower(props), '"k"') AND regexp_matches(props, '[13579]\\}$')
AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'""")
def log_filter(spark, d) -> DataFrame:
    return A.log_filter(table(spark, d, "events"), levels=["error", "signup"], exclude_components=[1, 2], text='"K"', pattern=r"[13579]\}$", since="2024-01-03", until="2024-01-20").select("event_id")


@query("SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total, ceil((SELECT count(*) FROM events WHERE event_type = 'error') / 25.0)::BIGINT AS pages FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def log_page(spark, d) -> DataFrame:
    rows = A.log_filter(table(spark, d, "events"), levels=["error"])
    return A.page(rows, [C("ts").desc(), C("event_id")], 3, 25).select("event_id", "user_id", "total", "pages")


@query("""SELECT hour, n, errors FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
WHERE errors > 3 AND errors::DOUBLE / n > 0.05""")
def alert_eval(spark, d) -> DataFrame:
    """Hours in which the number and the rate of errors are both over their limits."""
    hours = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.count_if(_is_error()).alias("errors"))
    return hours.where((C("errors") > 3) & (C("errors") / C("n") > 0.05)).select(C("w.start").alias("hour"), "n", "errors")


@query("SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10)::BIGINT + 1 END AS bucket, count(*) AS n FROM events GROUP BY 1")
def histogram(spark, d) -> DataFrame:
    return A.histogram(table(spark, d, "events"), "value", 0.0, 100.0, 10)


@query("SELECT s AS start, s + INTERVAL '10 minutes' AS stop, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, unnest([time_bucket(INTERVAL '5 minutes', ts), time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes']) AS s FROM events) GROUP BY s")
def sliding_latency(spark, d) -> DataFrame:
    return W.sliding_latency(table(spark, d, "events"))


@query("SELECT time_bucket(INTERVAL '1 minute', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d) -> DataFrame:
    return W.tumbling_counts(table(spark, d, "events"))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS stop, count(*) AS n FROM (
SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_counts(spark, d) -> DataFrame:
    return W.session_counts(table(spark, d, "events"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ((event_id % 5) * 10000000000 + epoch(date_trunc('second', ts))::BIGINT) DESC, event_id) AS place FROM events")
def queue_priority_order(spark, d) -> DataFrame:
    """The order in which a priority queue per user gives out its events: created plus priority, largest first."""
    from pyspark.sql import Window

    created = F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp"))
    score = (C("event_id") % 5) * F.lit(10_000_000_000) + created
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(score.desc(), "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", place.cast("long").alias("place"))


@query("SELECT role, resource, action, role = 'admin' OR (role = 'editor' AND resource = 'documents') OR (role = 'viewer' AND action = 'read') AS allowed FROM (VALUES ('admin'), ('editor'), ('viewer')) r(role), (VALUES ('documents'), ('users')) s(resource), (VALUES ('read'), ('write')) a(action)")
def permission_check(spark, d) -> DataFrame:
    grants = spark.createDataFrame([("admin", "*", "*"), ("editor", "documents", "*"), ("viewer", "*", "read")], "role string, resource string, action string")
    asked = spark.createDataFrame([(r, s, a) for r in ("admin", "editor", "viewer") for s in ("documents", "users") for a in ("read", "write")], "role string, resource string, action string")
    return A.allowed(asked, grants)
