"""Writes as transformations: upsert, update, delete, change feeds, versions, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as H
from ..streaming.windows import OnlineKMeans
from ..tables import table
from .registry import query

C = F.col
_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal FROM customer"
_NEW = "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS c_custkey, c_name, round(c_acctbal + 1, 2) AS c_acctbal FROM customer WHERE c_nationkey = 3"


def _customers(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "customer")
    key = F.when(C("c_custkey") % 2 == 0, C("c_custkey")).otherwise(C("c_custkey") + 1000000)
    new = rows.where("c_nationkey = 3").select(key.alias("c_custkey"), "c_name", F.round(C("c_acctbal") + 1, 2).alias("c_acctbal"))
    return rows.select("c_custkey", "c_name", "c_acctbal"), new


@query(f"WITH n AS ({_NEW}) SELECT * FROM ({_CUSTOMERS}) WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n")
def upsert_merge(spark, d) -> DataFrame:
    rows, new = _customers(spark, d)
    return H.upsert(rows, new, "c_custkey")


@query(f"WITH n AS ({_NEW}) SELECT r.c_custkey, r.c_name, coalesce(n.c_acctbal, r.c_acctbal) AS c_acctbal FROM ({_CUSTOMERS}) r LEFT JOIN n ON n.c_custkey = r.c_custkey")
def partial_update(spark, d) -> DataFrame:
    rows, new = _customers(spark, d)
    return H.partial_update(rows, new.select("c_custkey", "c_acctbal"), "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def delete_anti(spark, d) -> DataFrame:
    poor = table(spark, d, "customer").where("c_acctbal < 0").select(C("c_custkey").alias("o_custkey"))
    return H.delete_by_id(table(spark, d, "orders").select("o_orderkey", "o_custkey"), poor, "o_custkey")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 1000 THEN round(s_acctbal * 2, 2) ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_expr(spark, d) -> DataFrame:
    return H.update_where(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), C("s_acctbal") < 1000, {"s_acctbal": F.round(C("s_acctbal") * 2, 2)})


@query("SELECT event_id FROM (SELECT event_id, nullif(value, 0) AS v FROM events) WHERE (v > 50) IS NOT TRUE")
def delete_expr(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.nullif(C("value"), F.lit(0.0)).alias("v"))
    return H.delete_where(rows, C("v") > 50).select("event_id")


@query("""WITH f AS (SELECT user_id AS id, event_id AS at, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
base AS (SELECT c_custkey AS id, c_acctbal AS value FROM customer)
SELECT id, value FROM base WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT id, value FROM f WHERE event_type <> 'error'""")
def cdc_apply(spark, d) -> DataFrame:
    """Events as changes of customers: errors delete, all others set the value; the newest change of an id counts."""
    op = F.when(C("event_type") == "error", "delete").when(C("event_type") == "signup", "insert").otherwise("update")
    feed = table(spark, d, "events").select(C("user_id").alias("id"), "value", C("event_id").alias("at"), op.alias("op"))
    return H.apply_changes(table(spark, d, "customer").select(C("c_custkey").alias("id"), C("c_acctbal").alias("value")), feed, "id")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE n = 1 AND event_type <> 'error'""")
def mvcc_snapshot(spark, d) -> DataFrame:
    seen = H.snapshot(table(spark, d, "events"), "user_id", "ts", C("event_type") == "error", F.lit("2024-01-15").cast("timestamp_ntz"), "event_id")
    return seen.select("user_id", "event_id", "value")


@query("""WITH b AS (SELECT event_id, ts AS made, CASE WHEN event_type = 'signup' THEN 'full' WHEN event_type = 'view' THEN 'differential' ELSE 'incremental' END AS kind FROM events),
base AS (SELECT max(made) AS m FROM b WHERE kind <> 'incremental' AND made <= TIMESTAMP '2024-01-20')
SELECT event_id, kind FROM b, base WHERE made <= TIMESTAMP '2024-01-20' AND ((made = m AND kind <> 'incremental') OR (made > m AND kind = 'incremental'))""")
def pitr_select(spark, d) -> DataFrame:
    kind = F.when(C("event_type") == "signup", "full").when(C("event_type") == "view", "differential").otherwise("incremental")
    backups = table(spark, d, "events").select("event_id", C("ts").alias("at"), kind.alias("kind"))
    return H.point_in_time(backups, "2024-01-20").select("event_id", "kind")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS writes, count(*) FILTER (o_orderstatus <> 'O') AS reads, CASE WHEN w > 5 THEN 'universal' WHEN w < 0.2 THEN 'level' WHEN w > 2 OR w < 0.5 THEN 'fifo' ELSE 'adaptive' END AS policy FROM orders JOIN (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'O') / greatest(count(*) FILTER (o_orderstatus <> 'O'), 1)::DOUBLE AS w FROM orders GROUP BY 1) ON k = o_custkey GROUP BY o_custkey, w")
def compaction_choice(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(C("o_orderstatus") == "O").alias("writes"), F.count_if(C("o_orderstatus") != "O").alias("reads"))
    return rows.withColumn("policy", H.compaction_policy(C("writes"), C("reads")))


@query()
def stream_kmeans(spark, d) -> DataFrame:
    """The streaming update over the whole collection as one batch, from four rows as centroids."""
    rows = table(spark, d, "embeddings")
    start = [(i, list(r[0])) for i, r in enumerate(rows.orderBy("vec_id").select("embedding").limit(4).collect())]
    model = OnlineKMeans(start)
    model(rows.orderBy("vec_id"), 0)
    return spark.createDataFrame([(k, c) for k, c in model.centroids()], "cluster int, centroid array<double>")
