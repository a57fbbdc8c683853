"""Scalar functions and expression trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expression as E
from ..functions import udfs
from ..functions import vector as V
from ..tables import table
from .registry import query

C = F.col


@query("""SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, trim('  ' || c_name || ' ') AS t, concat(c_name, NULL, '-', c_mktsegment) AS c, ltrim('  x ') AS lt, rtrim('  x ') AS rt FROM customer""")
def fn_string(spark, d) -> DataFrame:
    name, segment = C("c_name"), C("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.upper(name).alias("u"), F.lower(segment).alias("l"), F.length(name).cast("long").alias("n"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("t"),
        F.concat_ws("", name, F.lit(None).cast("string"), F.lit("-"), segment).alias("c"), F.ltrim(F.lit("  x ")).alias("lt"), F.rtrim(F.lit("  x ")).alias("rt"))


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, extract(year FROM o_orderdate)::INT AS year, extract(quarter FROM o_orderdate)::INT AS quarter, extract(day FROM o_orderdate)::INT AS day, extract(dow FROM o_orderdate)::INT AS dow,
extract(hour FROM o_orderdate)::INT AS hour FROM orders""")
def fn_date(spark, d) -> DataFrame:
    at = C("o_orderdate")
    part = lambda name: F.extract(F.lit(name), at).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.date_trunc("month", at).cast("timestamp_ntz").alias("month"), part("year").alias("year"), part("quarter").alias("quarter"), part("day").alias("day"), (F.dayofweek(at) - 1).cast("int").alias("dow"), part("hour").alias("hour"))


@query()
def fn_now(spark, d) -> DataFrame:
    """The clock, as it can't be compared: whether the functions agree with each other."""
    return table(spark, d, "region").select("r_regionkey", (F.now() == F.current_timestamp()).alias("same"), (F.current_date() == F.to_date(F.now())).alias("today"))


@query("""SELECT event_id, coalesce(nullif(event_type, 'click'), 'was click') AS c, nullif(event_type, 'view') AS n, greatest(value, 50.0, NULL) AS g, least(value, 50.0) AS l FROM events""")
def fn_conditional(spark, d) -> DataFrame:
    kind, value = C("event_type"), C("value")
    return table(spark, d, "events").select("event_id", F.coalesce(F.nullif(kind, F.lit("click")), F.lit("was click")).alias("c"), F.nullif(kind, F.lit("view")).alias("n"), F.greatest(value, F.lit(50.0), F.lit(None).cast("double")).alias("g"), F.least(value, F.lit(50.0)).alias("l"))


@query("""SELECT event_id, abs(value - 50) AS a, ceil(value)::BIGINT AS c, floor(value)::BIGINT AS f, round(value, 1) AS r, round(sqrt(value), 6) AS s, round(power(value, 2), 6) AS p, round(exp(value / 100), 6) AS e,
round(ln(value + 1), 6) AS l, round(log10(value + 1), 6) AS l10, round(log(value + 1) / log(2), 6) AS l2 FROM (SELECT event_id, abs(value) AS value FROM events)""")
def fn_math(spark, d) -> DataFrame:
    x = F.abs(C("value"))
    six = lambda y, name: F.round(y, 6).alias(name)
    return table(spark, d, "events").select(
        "event_id", F.abs(x - 50).alias("a"), F.ceil(x).alias("c"), F.floor(x).alias("f"), F.round(x, 1).alias("r"), six(F.sqrt(x), "s"), six(F.power(x, F.lit(2)), "p"), six(F.exp(x / 100), "e"),
        six(F.ln(x + 1), "l"), six(F.log10(x + 1), "l10"), six(F.log(2.0, x + 1), "l2"))


@query("""SELECT event_id, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(tan(x), 6) AS t, round(asin(x), 6) AS as_, round(acos(x), 6) AS ac, round(atan(x), 6) AS at_ FROM (SELECT event_id, abs(value) / 1000 - floor(abs(value) / 1000) AS x FROM events)""")
def fn_trig(spark, d) -> DataFrame:
    y = F.abs(C("value")) / 1000
    rows = table(spark, d, "events").select("event_id", (y - F.floor(y)).alias("x"))
    six = lambda f, name: F.round(f("x"), 6).alias(name)
    return rows.select("event_id", six(F.sin, "s"), six(F.cos, "c"), six(F.tan, "t"), six(F.asin, "as_"), six(F.acos, "ac"), six(F.atan, "at_"))


@query("""SELECT vec_id, round(list_distance(v, q), 6) AS distance, round(list_cosine_similarity(v, q), 6) AS similarity, round(sqrt(list_inner_product(v, v)), 6) AS norm
FROM (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)""")
def fn_vector(spark, d) -> DataFrame:
    from ..operators.search import query_vector

    rows = table(spark, d, "embeddings")
    q = query_vector(rows, C("vec_id") == 0)
    return rows.select("vec_id", F.round(V.euclidean("embedding", q), 6).alias("distance"), F.round(V.cosine_similarity("embedding", q), 6).alias("similarity"), F.round(V.norm("embedding"), 6).alias("norm"))


# expression trees
def _events(spark, d, **trees: E.Node) -> DataFrame:
    return table(spark, d, "events").withColumnRenamed("value", "x").withColumn("y", C("user_id").cast("double")).select("event_id", *(F.round(E.column(t), 6).alias(name) for name, t in trees.items()))


_XY = "(SELECT event_id, value AS x, user_id::DOUBLE AS y FROM events)"
X, Y = E.var("x"), E.var("y")


@query(f"SELECT event_id, round(5 + x * 3, 6) AS a, round((x - y) / 4, 6) AS b, round(pow(x, 2) + -abs(y), 6) AS c, round(greatest(x, y), 6) AS hi, round(least(x, y), 6) AS lo FROM {_XY}")
def expr_eval(spark, d) -> DataFrame:
    return _events(spark, d, a=5 + X * 3, b=(X - Y) / 4, c=X**2 + -E.call("abs", Y), hi=E.call("max", X, Y), lo=E.call("min", X, Y))


@query(f"SELECT event_id, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(exp(x / 100), 6) AS e, round(ln(abs(x) + 1), 6) AS l, round(sqrt(abs(x)), 6) AS r FROM {_XY}")
def expr_math(spark, d) -> DataFrame:
    return _events(spark, d, s=E.parse("sin(x)"), c=E.parse("cos(x)"), e=E.parse("exp(x / 100)"), l=E.parse("log(abs(x) + 1)"), r=E.parse("sqrt(abs(x))"))


@query(f"SELECT event_id, CASE WHEN x - 50 > 0 THEN x ELSE -x END AS a, CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM {_XY}")
def expr_if(spark, d) -> DataFrame:
    return _events(spark, d, a=E.parse("x - 50 ? x : -x"), b=E.parse("if(y, 1, 0)"))


@query(f"SELECT event_id, abs(x) AS a, round(x) AS r, floor(x) AS f, ceil(x) AS c, round(pow(x, 1.5), 6) AS p, round(sqrt(x), 6) AS s, round(exp(x / 50), 6) AS e, round(ln(x + 1), 6) AS l, round(log10(x + 1), 6) AS l10 FROM (SELECT event_id, abs(value) AS x FROM events)")
def expr_calls(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.abs("value").alias("x"))
    trees = {"a": "abs(x)", "r": "round(x)", "f": "floor(x)", "c": "ceil(x)", "p": "pow(x, 1.5)", "s": "sqrt(x)", "e": "exp(x / 50)", "l": "ln(x + 1)", "l10": "log10(x + 1)"}
    return rows.select("event_id", *(F.round(E.column(E.parse(t)), 6).alias(name) for name, t in trees.items()))


@query("SELECT event_id, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(tan(x), 6) AS t, round(asin(x), 6) AS as_, round(acos(x), 6) AS ac, round(atan(x), 6) AS at_, round(sinh(x), 6) AS sh, round(cosh(x), 6) AS ch, round(tanh(x), 6) AS th, 0.0::DOUBLE AS none FROM (SELECT event_id, (event_id % 1000) / 1000.0::DOUBLE AS x FROM events)")
def expr_trig(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", ((C("event_id") % 1000) / F.lit(1000.0)).alias("x"))
    names = {"s": "sin", "c": "cos", "t": "tan", "as_": "asin", "ac": "acos", "at_": "atan", "sh": "sinh", "ch": "cosh", "th": "tanh"}
    return rows.select("event_id", *(F.round(E.column(E.call(f, X)), 6).alias(name) for name, f in names.items()), E.column(E.call("sin")).alias("none"))


@query(f"SELECT event_id, round(least(x, y, 20), 6) AS lo, round(greatest(x, y, 20), 6) AS hi, round((x + y + 20) / 3, 6) AS mean, round(x + y + 20, 6) AS total FROM {_XY}")
def expr_rowagg(spark, d) -> DataFrame:
    return _events(spark, d, lo=E.call("min", X, Y, 20), hi=E.call("max", X, Y, 20), mean=E.call("avg", X, Y, 20), total=E.call("sum", X, Y, 20))


@query(f"SELECT event_id, least(greatest(x, 10.0::DOUBLE), 60.0::DOUBLE) AS a FROM {_XY}")
def expr_clamp(spark, d) -> DataFrame:
    return _events(spark, d, a=E.call("clamp", X, 10, 60))


@query(f"SELECT event_id, round(x + (y - x) * 0.25, 6) AS a FROM {_XY}")
def expr_lerp(spark, d) -> DataFrame:
    return _events(spark, d, a=E.call("lerp", X, 0.25, Y))


# user-defined functions
@query("SELECT event_id, value + user_id AS total FROM events")
def udf_scalar(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", udfs.add_up()(C("value"), C("user_id")).alias("total"))


@query("SELECT event_type, round(exp(avg(ln(value))), 6) AS geo_mean FROM events WHERE value > 0 GROUP BY event_type")
def udaf_geo_mean(spark, d) -> DataFrame:
    """The aggregate is declared as a sum of logarithms, so it has partial sums like any built-in one."""
    return table(spark, d, "events").where("value > 0").groupBy("event_type").agg(F.round(udfs.geo_mean("value"), 6).alias("geo_mean"))


@query()
def udtf_ngrams(spark, d) -> DataFrame:
    udfs.register_ngrams(spark)
    table(spark, d, "conversations").createOrReplaceTempView("conversations")
    return spark.sql("SELECT conv_id, turn, g.position, g.ngram FROM conversations, LATERAL word_ngrams(text, 2) AS g")
