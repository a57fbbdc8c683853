"""Vector functions, exact and approximate search, quantization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import ann, filters
from ..operators import search as S
from ..tables import table
from .registry import query
from .sqlx import ann_search

C = F.col
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_SQL_DISTANCE = {
    "cosine": "1 - list_cosine_similarity(embedding::DOUBLE[], {q})",
    "euclidean": "list_distance(embedding::DOUBLE[], {q})",
    "manhattan": "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: abs(embedding[i]::DOUBLE - ({q})[i])))",
    "dot": "-list_inner_product(embedding::DOUBLE[], {q})",
}


def _top_sql(metric: str, where: str = "", extra: str = "", k: int = 10, offset: int = 0) -> str:
    distance = _SQL_DISTANCE[metric].format(q="q")
    return f"""SELECT vec_id, score, row_number() OVER (ORDER BY score, vec_id) AS rank FROM (
      SELECT * FROM (SELECT vec_id, label, round({distance}, 6) AS score FROM embeddings, (SELECT {_Q} AS q) {where}) {extra} ORDER BY score, vec_id LIMIT {k} OFFSET {offset})"""


def _first(spark, d) -> tuple[DataFrame, list[float]]:
    rows = table(spark, d, "embeddings")
    return rows, S.query_vector(rows, C("vec_id") == 0)


def _top(spark, d, **how) -> DataFrame:
    rows, q = _first(spark, d)
    return S.top_k(rows, q, **how).select("vec_id", "score", "rank")


@query(_top_sql("cosine"))
def vec_topk_cosine(spark, d) -> DataFrame:
    return _top(spark, d, metric="cosine")


@query(_top_sql("euclidean"))
def vec_topk_l2(spark, d) -> DataFrame:
    return _top(spark, d, metric="l2")


@query(_top_sql("manhattan"))
def vec_topk_l1(spark, d) -> DataFrame:
    return _top(spark, d, metric="l1")


@query(_top_sql("dot"))
def vec_topk_dot(spark, d) -> DataFrame:
    return _top(spark, d, metric="dot")


@query(_top_sql("euclidean", extra="WHERE score <= 1.3", k=1000000))
def vec_threshold(spark, d) -> DataFrame:
    return _top(spark, d, metric="l2", threshold=1.3, k=None)


@query(_top_sql("cosine", extra="WHERE score <= 0.95", k=15, offset=5))
def vec_search_paged(spark, d) -> DataFrame:
    """The builder's contract: threshold, then offset and limit, and ranks from 1 on the page."""
    return _top(spark, d, metric="cosine", threshold=0.95, k=15, offset=5)


@query(_top_sql("cosine", where="WHERE label IN (1, 2, 3)"))
def hybrid_search(spark, d) -> DataFrame:
    return _top(spark, d, metric="cosine", where=filters.predicate("label", "in", [1, 2, 3]))


@query(_top_sql("euclidean", k=7))
def ann_sql(spark, d) -> DataFrame:
    rows, q = _first(spark, d)
    statement = f"ANN SEARCH WITH (QUERY_VECTOR=[{','.join(map(repr, q))}], COLUMN=embedding, COLLECTION=embeddings, LIMIT_K=7, METRIC=l2)"
    return ann_search(spark, statement, lambda name: table(spark, d, name), id_col="vec_id").select("vec_id", "score", "rank")


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS similarity FROM embeddings")
def vec_similarity(spark, d) -> DataFrame:
    rows, q = _first(spark, d)
    return rows.select("vec_id", F.round(V.cosine_similarity("embedding", q), 6).alias("similarity"))


@query(f"""SELECT vec_id, round(list_cosine_similarity(e, {_Q}), 6) AS cosine, round(1 / (1 + list_distance(e, {_Q})), 6) AS euclidean, round(list_inner_product(e, {_Q}), 6) AS dot
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def ai_similarity(spark, d) -> DataFrame:
    rows, q = _first(spark, d)
    return rows.select("vec_id", *(F.round(V.similarity("embedding", q, m), 6).alias(m) for m in ("cosine", "euclidean", "dot")))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vec_norm(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"))


_EACH = "list_aggregate(list_transform(range(1, len(e) + 1), lambda i: round({x}, 6) * i), 'sum')"


@query("SELECT vec_id, " + ", ".join(f"round({_EACH.format(x=f'(e[i] {sign} q[i])')}, 4) AS {name}" for name, sign in (("added", "+"), ("taken", "-"), ("times", "*"))) + f" FROM (SELECT vec_id, embedding::DOUBLE[] AS e, {_Q} AS q FROM embeddings)")
def vec_elementwise(spark, d) -> DataFrame:
    """Element-wise results, weighted by position into one number each."""
    rows, q = _first(spark, d)
    weighed = lambda op: F.round(V.total(F.transform(V.elementwise("embedding", q, op), lambda x, i: F.round(x, 6) * (i + 1))), 4)
    return rows.select("vec_id", weighed("add").alias("added"), weighed("sub").alias("taken"), weighed("mul").alias("times"))


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n * x / n)), 6) AS length, round(e[1] / n, 6) AS first, round(e[-1] / n, 6) AS last FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def vec_normalize(spark, d) -> DataFrame:
    unit = V.normalized("embedding")
    rows = table(spark, d, "embeddings").select("vec_id", unit.alias("u"))
    return rows.select("vec_id", F.round(V.total(F.transform("u", lambda x: x * x)), 6).alias("length"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"))


@query("SELECT r_regionkey AS region, len([1.0, 2.0, 3.0]) AS dim, round(1.0::DOUBLE * r_regionkey + 2.0::DOUBLE, 6) AS total FROM region")
def vec_literal(spark, d) -> DataFrame:
    v = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    other = F.array(C("r_regionkey").cast("double"), F.lit(1.0), F.lit(0.0))
    return table(spark, d, "region").select(C("r_regionkey").alias("region"), F.size(v).cast("long").alias("dim"), F.round(V.dot(v, other), 6).alias("total"))


def _knn_sql(who: str, k: int) -> str:
    return f"""SELECT query_id, rank, neighbor_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, neighbor_id) AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {who})) WHERE rank <= {k}"""


@query(_knn_sql("WHERE a.vec_id % 100 = 0", 5))
def knn_join(spark, d) -> DataFrame:
    """Queries: ids divisible by 100; candidates: all rows."""
    rows = table(spark, d, "embeddings")
    return S.knn_join(rows.where("vec_id % 100 = 0"), rows, 5)


@query(_knn_sql("", 4))
def knn_graph(spark, d) -> DataFrame:
    """The exact graph of 4 neighbours, by blocks of vectors; for large collections ``ann.ivf_search`` searches cells."""
    rows = table(spark, d, "embeddings")
    return S.knn_join(rows, rows, 4)


@query()
def ann_recall(spark, d) -> DataFrame:
    """Recall of the three approximate searches, as registered, against the exact one, for the stated queries."""
    rows = table(spark, d, "embeddings")
    exact = S.knn_join(rows.where("vec_id % 100 = 0"), rows, 5)
    found = None
    for way in (ivf_search, lsh_candidates, annoy_search):
        hits = exact.join(way(spark, d).select("query_id", "neighbor_id"), ["query_id", "neighbor_id"], "left_semi").agg(F.lit(way.__name__).alias("method"), F.count("*").alias("hits"))
        found = hits if found is None else found.union(hits)
    expected = exact.agg(F.count("*").alias("expected"))
    return found.join(F.broadcast(expected)).select("method", "expected", "hits", (C("hits") / C("expected")).alias("recall"))


@query()
def lsh_candidates(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return ann.lsh_search(rows, rows.where("vec_id % 100 = 0"), 5)


@query()
def annoy_search(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return ann.forest_search(rows, rows.where("vec_id % 100 = 0"), 5)


@query()
def ivf_search(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return ann.ivf_search(ann.ivf_build(rows), rows.where("vec_id % 100 = 0"), 5, metric="cosine")


@query()
def pq_encode(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return ann.ProductQuantizer(subspaces=8, centroids=16).fit(rows).encode(rows)


@query()
def rvq_encode(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return ann.ResidualQuantizer(levels=2, subspaces=4, centroids=16).fit(rows).encode(rows)


@query("SELECT 64 AS dim, m AS subspaces, k AS centroids, round(64 * 32 / (m * log2(k)), 6) AS ratio, round(1 - (m * log2(k)) / (64 * 32), 6) AS savings FROM (VALUES (8, 256), (4, 16), (16, 256)) AS v(m, k)")
def compression_ratio(spark, d) -> DataFrame:
    rows = spark.createDataFrame([(64, 8, 256), (64, 4, 16), (64, 16, 256)], "dim int, subspaces int, centroids int")
    ratio = ann.ratio(C("dim"), C("subspaces"), C("centroids"))
    return rows.select("dim", "subspaces", "centroids", F.round(ratio, 6).alias("ratio"), F.round(1 - 1 / ratio, 6).alias("savings"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def unique_violations(spark, d) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT min(p_name) AS first, max(p_name) AS last, min(p_retailprice) AS cheapest, max(p_retailprice) AS dearest FROM part")
def first_last(spark, d) -> DataFrame:
    return table(spark, d, "part").agg(F.min("p_name").alias("first"), F.max("p_name").alias("last"), F.min("p_retailprice").alias("cheapest"), F.max("p_retailprice").alias("dearest"))


# clustering
_CENTROIDS = "(SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) AS r(i) GROUP BY label, i) GROUP BY label)"


@query("SELECT label, i AS position, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, (SELECT unnest(range(1, 65))::INT AS i) GROUP BY label, i")
def centroids(spark, d) -> DataFrame:
    from ..operators import clustering

    means = clustering.centroids(table(spark, d, "embeddings"), "label")
    return means.select("label", F.posexplode("centroid").alias("p", "x")).select("label", (C("p") + 1).alias("position"), F.round("x", 6).alias("mean"))


@query(f"""SELECT vec_id, arg_min(label, (d, label))::INT AS cluster, round(min(d), 6) AS distance FROM (
SELECT vec_id, m.label, round(list_distance(embedding::DOUBLE[], c), 9) AS d FROM embeddings, {_CENTROIDS} AS m) GROUP BY vec_id""")
def nearest_centroid(spark, d) -> DataFrame:
    from ..operators import clustering

    rows = table(spark, d, "embeddings")
    return clustering.assign(rows, clustering.collected(clustering.centroids(rows, "label"), "label")).select("vec_id", "cluster", F.round(F.round("distance", 9), 6).alias("distance"))


@query(f"""SELECT label, count(*) AS n, round(list_sum(any_value(c)), 6) AS centroid_sum, round(sum(list_inner_product(e, e)) / count(*) - list_inner_product(any_value(c), any_value(c)), 6) AS variance,
round(sqrt((sum(list_inner_product(e, e)) / count(*) - list_inner_product(any_value(c), any_value(c))) / 64), 6) AS radius FROM (SELECT e.label, embedding::DOUBLE[] AS e, c FROM embeddings e JOIN {_CENTROIDS} m ON e.label = m.label) GROUP BY label""")
def cf_stats(spark, d) -> DataFrame:
    from ..operators import clustering

    return clustering.cluster_features(table(spark, d, "embeddings"), "label").select("label", "n", F.round("centroid_sum", 6).alias("centroid_sum"), F.round("variance", 6).alias("variance"), F.round("radius", 6).alias("radius"))


@query(f"""WITH m AS {_CENTROIDS}, own AS (SELECT e.vec_id, e.label, list_distance(e.embedding::DOUBLE[], m.c) AS to_own, sum(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) OVER (PARTITION BY e.label) AS ss, count(*) OVER (PARTITION BY e.label) AS n,
  list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS xx, list_inner_product(e.embedding::DOUBLE[], m.c) AS xc FROM embeddings e JOIN m ON e.label = m.label),
o AS (SELECT e.vec_id, min(list_distance(e.embedding::DOUBLE[], m.c)) AS b FROM embeddings e JOIN m ON e.label <> m.label GROUP BY e.vec_id),
s AS (SELECT sqrt(greatest(xx - 2 * xc + ss / n, 0)) AS a, b FROM own JOIN o USING (vec_id))
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s""")
def silhouette(spark, d) -> DataFrame:
    from ..operators import clustering

    return clustering.silhouette(table(spark, d, "embeddings"), "label").select(F.round("silhouette", 6).alias("silhouette"))


@query()
def kmeans_sizes(spark, d) -> DataFrame:
    from ..operators import clustering

    rows = table(spark, d, "embeddings")
    model = clustering.kmeans(rows, k=8)
    return clustering.assign(rows, model).groupBy("cluster").agg(F.count("*").alias("n"))
