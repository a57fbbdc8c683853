"""Vector functions, expressions, text functions and user-defined functions on small inputs."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vectrail.functions import expression as E
from vectrail.functions import text as T
from vectrail.functions import udfs
from vectrail.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_distances(spark):
    a, b = [1.0, 2.0, 3.0], [4.0, 5.0, 6.0]
    assert one(spark, V.euclidean(a, b)) == pytest.approx(5.196152, abs=1e-6)
    assert one(spark, V.manhattan(a, b)) == 9.0
    assert one(spark, V.cosine([1, 0, 0], [1, 0, 0])) == 0.0
    assert one(spark, V.cosine([1, 0, 0], [0, 1, 0])) == 1.0
    assert one(spark, V.distance(a, b, "mips")) == -32.0
    assert one(spark, V.squared_l2(a, b)) == 27.0


def test_zero_vectors_and_dimensions(spark):
    assert one(spark, V.cosine([0, 0], [1, 1])) == 0.0
    assert one(spark, V.cosine([0, 0], [1, 1], "miss")) == 1.0
    assert one(spark, V.cosine_similarity([0, 0], [1, 1])) == 0.0
    assert one(spark, V.similarity([1, 0], [1, 0, 0])) == 0.0
    assert one(spark, V.normalized([0, 0])) == [0.0, 0.0]
    with pytest.raises(PySparkException):
        one(spark, V.euclidean([1, 2, 3], [4, 5]))


def test_elementwise(spark):
    assert one(spark, V.elementwise([1, 2], [3, 4], "mul")) == [3.0, 8.0]
    assert one(spark, V.elementwise([1, 2], [0, 4], "div")) == [None, 0.5]


def test_metric_properties(spark):
    rows = spark.range(30).select(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(100)) / 10).alias("v"))
    pairs = rows.alias("a").join(rows.alias("b")).join(rows.alias("c"))
    for metric in ("euclidean", "manhattan"):
        ab, ba, bc, ac = (V.distance(f"{x}.v", f"{y}.v", metric) for x, y in ("ab", "ba", "bc", "ac"))
        assert pairs.where((F.abs(ab - ba) > 1e-9) | (ac > ab + bc + 1e-9)).count() == 0


@pytest.mark.parametrize(("text", "x", "value"), [("5 + x * 3", 4, 17), ("if(x, 1, 0)", 1, 1), ("if(x, 1, 0)", 0, 0), ("sqrt(x)", 16, 4), ("2 ^ x ^ 2", 2, 16), ("-x + 1", 3, -2), ("clamp(x, 0, 1)", 5, 1), ("lerp(0, 0.5, x)", 8, 4), ("x > 0", 1, None)])
def test_expressions(spark, text, x, value):
    if value is None:
        with pytest.raises(ValueError):
            E.parse(text)
    else:
        assert spark.createDataFrame([(float(x),)], "x double").select(E.column(E.parse(text))).first()[0] == value


def test_expression_errors(spark):
    rows = spark.createDataFrame([(10.0,)], "x double")
    for text in ("x / 0", "ln(0 - x)", "sqrt(0 - x)", "missing + 1"):
        with pytest.raises(PySparkException):
            rows.select(E.column(E.parse(text))).first()
    assert rows.select(E.column(E.parse("x / 0"), safe=True)).first()[0] is None
    assert rows.select(E.column(E.parse("sin(1.5707963267948966)"))).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        E.column(E.call("nothing", 1))
    with pytest.raises(ValueError):
        E.column(E.call("clamp", 1))


def test_expression_trees():
    tree = E.parse("1 + 2")
    assert E.folded(tree) == E.const(3) and E.is_constant(tree) and E.complexity(tree) == 3
    assert not E.is_constant(E.parse("1 + x")) and E.variables(E.parse("x + y * x")) == {"x", "y"}
    assert str(E.parse("(1 + x) * 2")) == "((1 + x) * 2)"


def test_text(spark):
    rows = spark.createDataFrame([("Contact us at info@example.com or call +1-555-123-4567. Visit https://www.example.com today, Maria",), ("",), (None,)], "t string")
    found = rows.select(T.emails("t"), T.urls("t"), T.phones("t"), T.persons("t"), T.sentiment("t")).collect()
    assert found[0][0] == ["info@example.com"] and found[0][1] == ["https://www.example.com"] and "555-123-4567" in found[0][2][0]
    assert found[0][3] == ["Contact", "Visit", "Maria"] and found[1][4].sentiment == "neutral"
    one = spark.createDataFrame([(1, "machine learning and machine vision: learning, learning!")], "id int, t string")
    assert [(r.keyword, r.n) for r in T.keywords(one, "id", "t").orderBy("rank").collect()] == [("learning", 3), ("machine", 2), ("vision", 1)]
    vector = spark.range(1).select(T.vectorize(F.lit("Hello world"))).first()[0]
    assert len(vector) == 384 and math.isclose(sum(x * x for x in vector), 1.0, rel_tol=1e-9)


def test_registry(spark):
    registry = udfs.FunctionRegistry(spark)
    def triple(s: "pd.Series") -> "pd.Series":  # noqa: F821
        return s * 3
    import pandas as pd

    triple.__annotations__ = {"s": pd.Series, "return": pd.Series}
    registry.register("triple", triple, "double")
    assert registry.exists("triple") and registry.names() == ["triple"]
    assert spark.range(1, 3).select(registry.call("triple", "id")).collect()[1][0] == 6.0
    assert spark.sql("SELECT triple(2)").first()[0] == 6.0
    with pytest.raises(ValueError):
        registry.register("triple", triple, "double")
    registry.unregister("triple")
    with pytest.raises(KeyError):
        registry.call("triple", "id")
