"""Scans, projections, predicates, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.search import placed
from ..tables import table, views
from .registry import query

C = F.col


def _revenue():
    return C("l_extendedprice") * (1 - C("l_discount"))


# scans and projection
@query("SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_quantity > 30")
def scan_project(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity > 30").select("l_orderkey", "l_linenumber", "l_quantity", F.round(_revenue(), 4).alias("revenue"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-12-31'")
def index_range_scan(spark, d) -> DataFrame:
    dates = C("l_shipdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    return table(spark, d, "lineitem").where(dates).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 50")
def filter_full_scan(spark, d) -> DataFrame:
    return table(spark, d, "events").where((C("event_type") == "purchase") & (C("value") >= 50)).select("event_id", "user_id", "value")


@query("SELECT w.id AS wanted, o_orderkey, o_totalprice FROM (VALUES (3), (7), (11), (-1)) AS w(id) LEFT JOIN orders ON o_orderkey = w.id")
def point_lookup(spark, d) -> DataFrame:
    wanted = spark.createDataFrame([(3,), (7,), (11,), (-1,)], "wanted int")
    return wanted.join(table(spark, d, "orders"), C("wanted") == C("o_orderkey"), "left").select("wanted", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 10")
def list_page(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").offset(10).limit(10)


@query("SELECT 'documents' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages")
def count_documents(spark, d) -> DataFrame:
    count = lambda name: table(spark, d, name).agg(F.lit(name).alias("collection"), F.count("*").alias("n"))
    return count("documents").union(count("embeddings")).union(count("pages"))


@query("SELECT count(*) AS n_documents, count(DISTINCT source) AS n_sources, sum(strlen(text))::BIGINT AS bytes, max(strlen(text))::BIGINT AS largest, round(avg(n_chars), 4) AS mean_chars FROM documents")
def collection_stats(spark, d) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, d, "documents").agg(F.count("*").alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.sum(size).alias("bytes"), F.max(size).cast("long").alias("largest"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT * FROM nation")
def select_star(spark, d) -> DataFrame:
    return table(spark, d, "nation").select("*")


@query("SELECT c_custkey AS customer, upper(c_mktsegment) AS segment, c_acctbal AS balance FROM customer")
def project_alias(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(C("c_custkey").alias("customer"), F.upper("c_mktsegment").alias("segment"), C("c_acctbal").alias("balance"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def select_distinct(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000")
def filter_where(spark, d) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 250000").select("o_orderkey", "o_totalprice")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS added, round(l_extendedprice - l_discount, 6) AS taken, round(l_quantity * l_tax, 6) AS times,
round(l_extendedprice / l_quantity, 8) AS divided, l_orderkey % 7 AS rest FROM lineitem""")
def arith_ops(spark, d) -> DataFrame:
    six = lambda x, name: F.round(x, 6).alias(name)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", six(C("l_quantity") + C("l_tax"), "added"), six(C("l_extendedprice") - C("l_discount"), "taken"),
        six(C("l_quantity") * C("l_tax"), "times"), F.round(C("l_extendedprice") / C("l_quantity"), 8).alias("divided"), (C("l_orderkey") % 7).alias("rest"))


@query("SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
def compare_ops(spark, d) -> DataFrame:
    x = C("p_size")
    return table(spark, d, "part").select("p_partkey", (x == 10).alias("eq"), (x != 10).alias("ne"), (x < 10).alias("lt"), (x <= 10).alias("le"), (x > 10).alias("gt"), (x >= 10).alias("ge"))


@query("SELECT event_id FROM events WHERE (event_type = 'click' AND value > 10) OR NOT (event_type IN ('click', 'view') OR value < 90)")
def logical_ops(spark, d) -> DataFrame:
    kind, value = C("event_type"), C("value")
    return table(spark, d, "events").where((kind == "click") & (value > 10) | ~(kind.isin("click", "view") | (value < 90))).select("event_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' AND p_name NOT LIKE 'red%'")
def like_filter(spark, d) -> DataFrame:
    return table(spark, d, "part").where(C("p_name").like("%ring%") & ~C("p_name").like("red%")).select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%THE AND%' AND lang NOT ILIKE 'D%'")
def ilike_filter(spark, d) -> DataFrame:
    return table(spark, d, "documents").where(C("text").ilike("%THE AND%") & ~C("lang").ilike("D%")).select("doc_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def in_list(spark, d) -> DataFrame:
    return table(spark, d, "customer").where(C("c_mktsegment").isin("BUILDING", "MACHINERY") & ~C("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity NOT BETWEEN 10 AND 40")
def between_filter(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where(C("l_discount").between(0.05, 0.07) & ~C("l_quantity").between(10, 40)).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT c_custkey, o_orderkey IS NULL AS without, o_orderkey IS NOT NULL AS with_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000")
def null_predicates(spark, d) -> DataFrame:
    dear = table(spark, d, "orders").where("o_totalprice > 450000").select("o_custkey", "o_orderkey")
    return table(spark, d, "customer").join(dear, C("o_custkey") == C("c_custkey"), "left").select("c_custkey", C("o_orderkey").isNull().alias("without"), C("o_orderkey").isNotNull().alias("with_order"))


@query("SELECT s_suppkey, -s_acctbal AS minus, +s_acctbal AS plus, - -s_suppkey AS twice FROM supplier")
def unary_ops(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", (-C("s_acctbal")).alias("minus"), F.expr("+s_acctbal").alias("plus"), F.expr("-(-s_suppkey)").alias("twice"))


@query("SELECT p_partkey, round(pow(p_size, 2), 6) AS squared, p_brand || '/' || p_type AS label FROM part")
def pow_concat(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(F.pow("p_size", F.lit(2)), 6).alias("squared"), F.expr("p_brand || '/' || p_type").alias("label"))


@query("""SELECT event_id, value::BIGINT AS rounded, user_id::VARCHAR AS user_text, (event_id % 2)::BOOLEAN AS odd, CAST(ts AS DATE) AS day, TRY_CAST(event_type AS INTEGER) AS none
FROM (SELECT event_id, floor(value) AS value, user_id, ts, event_type FROM events)""")
def cast_types(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.floor("value").cast("bigint").alias("rounded"), C("user_id").cast("string").alias("user_text"), (C("event_id") % 2).cast("boolean").alias("odd"), C("ts").cast("date").alias("day"), C("event_type").try_cast("int").alias("none"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def case_when(spark, d) -> DataFrame:
    price = C("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(price > 300000, "high").when(price > 100000, "mid").otherwise("low").alias("band"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists_semi(spark, d) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, C("o_custkey") == C("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer i WHERE i.c_nationkey = c.c_nationkey)")
def scalar_subquery(spark, d) -> DataFrame:
    views(spark, d, "customer")
    return spark.sql("SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer i WHERE i.c_nationkey = c.c_nationkey)")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery(spark, d) -> DataFrame:
    views(spark, d, "orders", "customer")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000.0")
def param_query(spark, d) -> DataFrame:
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice >= :least", args={"status": "O", "least": 200000.0}, orders=table(spark, d, "orders"))


@query("SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) AS s WHERE n > 10")
def derived_table(spark, d) -> DataFrame:
    views(spark, d, "orders")
    return spark.sql("SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) AS s WHERE n > 10")


# joins
def _joined(spark, d, how: str) -> DataFrame:
    rich = table(spark, d, "supplier").where("s_acctbal > 3000").select("s_suppkey", "s_nationkey")
    nations = table(spark, d, "nation").where("n_regionkey <> 2").select("n_nationkey", "n_name")
    return nations.join(rich, C("n_nationkey") == C("s_nationkey"), how).select("n_name", "s_suppkey")


_JOIN = "SELECT n_name, s_suppkey FROM (SELECT * FROM nation WHERE n_regionkey <> 2) {} JOIN (SELECT * FROM supplier WHERE s_acctbal > 3000) ON n_nationkey = s_nationkey"


@query(_JOIN.format("INNER"))
def join_inner(spark, d) -> DataFrame:
    return _joined(spark, d, "inner")


@query(_JOIN.format("LEFT"))
def join_left(spark, d) -> DataFrame:
    return _joined(spark, d, "left")


@query(_JOIN.format("RIGHT"))
def join_right(spark, d) -> DataFrame:
    return _joined(spark, d, "right")


@query(_JOIN.format("FULL"))
def join_full(spark, d) -> DataFrame:
    return _joined(spark, d, "full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d) -> DataFrame:
    """The cross join operator itself, on the two tables of fixed size."""
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name"))


@query("SELECT nationkey, c_custkey, s_suppkey FROM (SELECT c_nationkey AS nationkey, c_custkey FROM customer WHERE c_acctbal > 9500) NATURAL JOIN (SELECT s_nationkey AS nationkey, s_suppkey FROM supplier)")
def join_natural(spark, d) -> DataFrame:
    views(spark, d, "customer", "supplier")
    return spark.sql("SELECT nationkey, c_custkey, s_suppkey FROM (SELECT c_nationkey AS nationkey, c_custkey FROM customer WHERE c_acctbal > 9500) NATURAL JOIN (SELECT s_nationkey AS nationkey, s_suppkey FROM supplier)")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def join_theta(spark, d) -> DataFrame:
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    return a.join(b, (C("a.n_regionkey") < C("b.n_regionkey")) & (C("a.n_nationkey") > C("b.n_nationkey"))).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_broadcast_hint(spark, d) -> DataFrame:
    """Nations are a table of fixed size, so the hint is safe at any scale."""
    return table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), C("c_nationkey") == C("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""")
def entity_hop(spark, d) -> DataFrame:
    """Three hops along typed edges. Orders are counted per customer before they meet the nations."""
    per_customer = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    hops = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(per_customer, C("o_custkey") == C("c_custkey"), "left")
    hops = hops.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))
    return hops.join(table(spark, d, "nation"), C("c_nationkey") == C("n_nationkey")).join(table(spark, d, "region"), C("n_regionkey") == C("r_regionkey")).select("r_name", "n_name", "customers", "orders")


# aggregates
@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def group_agg(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").where(C("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(_revenue()), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n > 12")


@query("SELECT count(*) AS n, count(o_custkey) AS n_keys, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def agg_basic(spark, d) -> DataFrame:
    x = "o_totalprice"
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.count("o_custkey").alias("n_keys"), F.round(F.sum(x), 2).alias("total"), F.round(F.avg(x), 4).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))


@query("SELECT n_regionkey, to_json(list(n_name ORDER BY n_name))::VARCHAR AS names FROM nation GROUP BY n_regionkey")
def array_agg(spark, d) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("names"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_agg(spark, d) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name)").alias("names"))


@query("SELECT n_regionkey, to_json(list({'k': n_nationkey, 'name': n_name} ORDER BY n_nationkey))::VARCHAR AS nations FROM nation GROUP BY n_regionkey")
def json_agg(spark, d) -> DataFrame:
    entry = F.struct(C("n_nationkey").alias("k"), C("n_name").alias("name"))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("nations"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query()
def approx_distinct(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::BIGINT AS all_flags FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("long").alias("all_flags"))


# windows
@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)""")
def win_rank(spark, d) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    loose = by.orderBy("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(by.orderBy("o_orderpriority", "o_orderkey")).cast("long").alias("rn"), F.rank().over(loose).cast("long").alias("rk"), F.dense_rank().over(loose).cast("long").alias("dr"))


@query("SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2, -1.0).over(w).alias("after"))


@query("""SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_running(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 4).alias("moving"))


# sorting and limits; the row numbers make the order part of the result
@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal, c_custkey) AS place FROM customer")
def order_by(spark, d) -> DataFrame:
    """All rows with their place by three keys."""
    rows = table(spark, d, "customer").withColumn("step", F.floor(C("c_acctbal") / 10))
    return placed(rows, [C("c_mktsegment").desc(), C("step")], [C("c_acctbal"), C("c_custkey")], ["c_mktsegment", "step"]).select("c_custkey", "place")


_RARE = "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS balance FROM customer"


@query(f"SELECT c_custkey, balance, row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY balance NULLS FIRST, c_custkey) AS up, row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY balance DESC NULLS LAST, c_custkey) AS down FROM ({_RARE})")
def order_nulls(spark, d) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.when(C("c_acctbal") > 5000, C("c_acctbal")).alias("balance"))
    by = Window.partitionBy(C("c_custkey") % 10)
    return rows.select("c_custkey", "balance", F.row_number().over(by.orderBy(C("balance").asc_nulls_first(), "c_custkey")).cast("long").alias("up"), F.row_number().over(by.orderBy(C("balance").desc_nulls_last(), "c_custkey")).cast("long").alias("down"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20 OFFSET 5")
def limit_offset(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(C("l_extendedprice").desc(), "l_orderkey", "l_linenumber").offset(5).limit(20)


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) AS place FROM documents")
def sort_by_field(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", F.floor(C("doc_id") / 1024).alias("step"))
    return placed(rows, [C("lang").asc_nulls_first(), C("step")], [C("doc_id")], ["lang", "step"]).select("doc_id", "lang", "place")


# set operations
def _nations(spark, d) -> tuple[DataFrame, DataFrame]:
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select(C("c_nationkey").alias("nation"))
    poor = table(spark, d, "supplier").where("s_acctbal < 1500").select(C("s_nationkey").alias("nation"))
    return rich, poor


_SETS = "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 {} SELECT s_nationkey FROM supplier WHERE s_acctbal < 1500"


@query(_SETS.format("UNION"))
def set_union(spark, d) -> DataFrame:
    a, b = _nations(spark, d)
    return a.union(b).distinct()


@query(_SETS.format("UNION ALL"))
def set_union_all(spark, d) -> DataFrame:
    a, b = _nations(spark, d)
    return a.union(b)


@query(_SETS.format("INTERSECT"))
def set_intersect(spark, d) -> DataFrame:
    a, b = _nations(spark, d)
    return a.intersect(b)


@query(_SETS.format("EXCEPT"))
def set_except(spark, d) -> DataFrame:
    a, b = _nations(spark, d)
    return a.subtract(b)
