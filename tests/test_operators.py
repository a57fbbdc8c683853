"""Search, filters, builder, clustering, compression, changes, collections and streams on small inputs."""

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vectrail.operators import analytics, ann, changes, clustering, filters
from vectrail.operators import builder as B
from vectrail.operators import search as S
from vectrail.plans import catalog, sqlx
from vectrail.sources import files
from vectrail.sources.collection import Field, Schema, Store
from vectrail.streaming import windows as W


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([("doc1", [1.0, 2.0, 3.0], 1), ("doc2", [4.0, 5.0, 6.0], 2), ("doc3", [7.0, 8.0, 9.0], None)], "id string, v array<float>, n int")


def test_top_k(spark, points):
    found = S.top_k(points, [1.1, 2.1, 3.1], 2, "v", "id", "l2").select("id", "rank").collect()
    assert [tuple(r) for r in found] == [("doc1", 1), ("doc2", 2)]
    assert S.top_k(points, [1.1, 2.1, 3.1], 10, "v", "id", "l2", threshold=1.0).count() == 1
    assert S.top_k(points, [0.0, 0.0, 0.0], 3, "v", "id", offset=5).count() == 0
    axes = spark.createDataFrame([("e1", [1.0, 0.0, 0.0]), ("e2", [0.0, 1.0, 0.0]), ("e3", [0.0, 0.0, 1.0])], "id string, v array<float>")
    assert [r.id for r in S.top_k(axes, [1, 0, 0], 3, "v", "id").collect()] == ["e1", "e2", "e3"]
    assert S.top_k(axes.limit(0), [1, 0, 0], 3, "v", "id").count() == 0


def test_pages_make_the_order(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    q = S.query_vector(rows, F.col("vec_id") == 3)
    whole = [r.vec_id for r in S.top_k(rows, q, 30).collect()]
    assert [r.vec_id for p in range(3) for r in S.top_k(rows, q, 10, offset=10 * p).collect()] == whole
    assert whole[0] == 3


def test_knn_join_equals_top_k(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    for metric in ("cosine", "l1", "l2", "dot"):
        found = S.knn_join(rows.where("vec_id = 5"), rows, 4, metric=metric).orderBy("rank").collect()
        wanted = S.top_k(rows.where("vec_id <> 5"), S.query_vector(rows, F.col("vec_id") == 5), 4, metric=metric).collect()
        assert [(r.neighbor_id, r.rank) for r in found] == [(r.vec_id, r.rank) for r in wanted]


def test_predicates(spark):
    row = spark.createDataFrame([(1, "Alice", 30, ["developer", "rust"], None)], "id long, name string, age long, tags array<string>, none string")
    holds = lambda c: row.where(c).count() == 1
    P = filters.predicate
    assert holds(P("name", "eq", "Alice")) and not holds(P("name", "ne", "Alice")) and holds(P("age", "gte", 30)) and not holds(P("age", "lt", 30))
    assert holds(P("tags", "contains", "rust", is_array=True)) and holds(P("name", "contains", "lic")) and holds(P("age", "in", [1, 30])) and not holds(P("age", "not_in", [30]))
    assert not any(holds(P("none", op, v)) for op, v in (("eq", "x"), ("ne", "x"), ("not_contains", "x"), ("not_in", ["x"])))
    with pytest.raises(ValueError):
        P("age", "in", 3)


def test_builder(points):
    found = B.QueryBuilder("c").near([1, 2, 3], "v", "l2").where(B.any_of(B.where("n", "eq", 1), B.not_(B.where("n", "eq", 2)))).limit(5).run(points)
    assert [(r.document_id, r.rank) for r in found.collect()] == [("doc1", 1), ("doc3", 2)]
    assert found.first().document.n == 1
    down = B.QueryBuilder("c").filter("id", "contains", "doc").sort("n", ascending=False).include(documents=False).run(points).collect()
    assert [r.document_id for r in down] == ["doc2", "doc1", "doc3"] and down[0].document is None and down[0].score is None
    for bad in (B.QueryBuilder(""), B.QueryBuilder("c"), B.QueryBuilder("c").near([1]).limit(0), B.QueryBuilder("c").where(B.all_of()), B.QueryBuilder("c").filter("", "eq", 1)):
        with pytest.raises(ValueError):
            bad.run(points)


def test_ann_statement(spark, points):
    points.createOrReplaceTempView("points")
    text = "ANN SEARCH WITH (QUERY_VECTOR=[1.0,2.0,3.0], COLUMN=v, COLLECTION=points, LIMIT_K=2, METRIC='l2')"
    assert [r.id for r in sqlx.run_sql(spark, text).collect()] == ["doc1", "doc2"]
    parsed = sqlx.parse_ann("ann search with (query_vector=[1,2], collection=documents)")
    assert (parsed.k, parsed.metric, parsed.column, parsed.query_vector) == (10, "cosine", "embedding", (1.0, 2.0))
    assert "points" in sqlx.run_sql(spark, f"EXPLAIN {text}").first()[0] or sqlx.run_sql(spark, f"EXPLAIN {text}").count() == 1
    assert sqlx.translate("CREATE TABLE t (id INTEGER, v VECTOR(3))") == "CREATE TABLE t (id BIGINT, v ARRAY<FLOAT>) USING parquet"
    for bad in ("ANN SEARCH WITH (COLLECTION=x)", "ANN SEARCH WITH (QUERY_VECTOR=[1], NO=1)", "ANN SEARCH WITH (QUERY_VECTOR=[1], LIMIT_K=0)", "SELECT 1"):
        with pytest.raises(ValueError):
            sqlx.parse_ann(bad)


def test_recall(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    queries = rows.where("vec_id % 25 = 0")
    exact = S.knn_join(queries, rows, 5).select("query_id", "neighbor_id")
    holes = rows.union(spark.createDataFrame([(10**6, None, 0)], rows.schema))
    for found in (ann.ivf_search(ann.ivf_build(holes), queries, 5, metric="cosine"), ann.lsh_search(holes, queries, 5), ann.forest_search(holes, queries, 5)):
        assert found.join(exact, ["query_id", "neighbor_id"]).count() >= 0.9 * exact.count()


def test_recall_of_registered_searches(spark):
    found = catalog.queries()["ann_recall"](spark, "/root/testdata/sf0.1" if os.path.exists("/root/testdata/sf0.1") else os.environ["VECTRAIL_TEST_DATA"])
    assert [r.method for r in found.collect() if r.recall < 0.9] == []


def test_probes_are_chosen_in_little_driver_memory(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, means = rng.normal(size=(640, 64)), rng.normal(size=(1024, 64))
    rows = spark.createDataFrame([(i, v, i) for i, v in enumerate(means[:8].tolist())], "vec_id long, embedding array<double>, cluster int")
    monkeypatch.setattr(ann, "calibration", lambda *a: (n + 0.01, n))
    tracemalloc.start()
    found = ann.ivf_search(ann.IvfIndex(list(enumerate(means.tolist())), rows, "vec_id", "embedding"), rows, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert found.count() <= 8
    x = rng.normal(size=(600, 64))
    assert (ann._nearest_cells(x, means)[:, 0] == ((x[:, None, :] - means[None]) ** 2).sum(2).argmin(1)).all()


def test_trees_take_little_driver_memory(spark):
    points = np.random.default_rng(5).normal(size=(4096, 4))
    rows = spark.createDataFrame([(v,) for v in points.tolist()], "embedding array<double>")
    tracemalloc.start()
    grown = ann.forest(rows, 24, leaf=1)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 10e6
    axis, at, right = grown[0]
    def walk(x) -> int:
        node = 0
        while axis[node] >= 0:
            node = node + 1 if x[axis[node]] < at[node] else right[node]
        return node
    assert ann.leaves_of(grown[:1], points)[0].tolist() == [walk(x) for x in points]


def test_repeated_ids_in_a_batch(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 6), (3, "p", 7), (3, "q", 8)], "id int, s string, n int").coalesce(1)
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    assert plain(changes.upsert(rows, new, "id")) == [(1, "a", 1), (2, "y", 6), (3, "q", 8)]
    assert plain(changes.upsert(rows, new, "id", "update")) == [(1, "a", 1), (2, "y", 6)]
    assert plain(changes.upsert(rows, new, "id", "insert")) == [(1, "a", 1), (2, "b", 2), (3, "p", 7)]
    patches = spark.createDataFrame([(2, "x", None), (2, None, 9), (2, "z", None)], "id int, s string, n int").coalesce(1)
    assert plain(changes.partial_update(rows, patches, "id")) == [(1, "a", 1), (2, "z", 9)]


def test_quantizers(spark):
    x = np.random.default_rng(1).normal(size=(400, 16))
    pq = ann.ProductQuantizer(4, 32).fit_points(x)
    codes = pq.codes(x)
    assert codes.shape == (400, 4) and pq.decode(codes).shape == x.shape and pq.stats(16)["ratio"] > 1
    assert np.allclose(pq.adc(x[0], codes), np.sqrt(((pq.decode(codes) - x[0]) ** 2).sum(1)))
    assert np.allclose(pq.sdc(codes[:1], codes[:1]), 0)
    rvq = ann.ResidualQuantizer(3, 4, 32).fit_points(x)
    assert ((rvq.decode(rvq.codes(x)) - x) ** 2).mean() < ((pq.decode(codes) - x) ** 2).mean()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = pq.search(pq.encode(rows), x[7], 5).collect()
    assert [r.score for r in found] == sorted(r.score for r in found) and found[0].score == pytest.approx(pq.adc(x[7], codes).min(), abs=1e-6)
    for bad in (ann.ProductQuantizer(7, 16), ann.ProductQuantizer(4, 1000)):
        with pytest.raises(ValueError):
            bad.fit_points(x)


def test_clusters(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 10 + i / 100, 0.0]) for i in range(40)], "vec_id long, embedding array<double>")
    model = clustering.kmeans(rows, 2)
    labelled = clustering.assign(rows, model)
    assert labelled.groupBy("cluster").count().where("count = 20").count() == 2
    assert clustering.silhouette(labelled, "cluster").first()[0] > 0.9
    assert len(clustering.birch(rows, 1.0)) == 2
    assert clustering.balanced({0: 5, 1: 0, 2: 1, 3: 2}, 2) == [(0,), (2, 3)]
    with pytest.raises(ValueError):
        clustering.kmeans(rows, 1)
    tie = clustering.assign(spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<double>"), [(3, [1.0, 0.0]), (5, [0.0, 1.0])])
    assert tie.first().cluster == 3
    online = W.OnlineKMeans([(0, [0.0, 0.0]), (1, [10.0, 0.0])])
    online(rows, 0)
    online(rows, 0)
    assert online.centroids()[1][1][0] > online.centroids()[0][1][0] and online.seen == 0


def test_nearest_rank_ways_agree(spark, data):
    rows = spark.read.parquet(f"{data}/events.parquet")
    a = {r[0]: r[1:] for r in rows.groupBy("event_type").agg(*(analytics.nearest_rank("value", p) for p in (0.5, 0.99))).collect()}
    b = {r[0]: r[1:] for r in analytics.nearest_rank_by(rows, ["event_type"], "value", [0.5, 0.99]).collect()}
    assert a == b


def test_alerts_and_samples(spark):
    row = spark.createDataFrame([(95.0, 10.0, 10.0, 2000.0, 0.0)], "cpu double, memory double, disk double, latency_ms double, failure_rate double")
    assert {r.name for r in analytics.alerts(row).collect()} == {"cpu", "latency_ms"}
    rows = spark.range(10000)
    assert 1700 < analytics.deterministic_sample(rows, "id", 20).count() < 2300
    assert spark.range(0).agg(analytics.rate(F.col("id") > 0)).first()[0] == 0.0


def test_changes(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, name string, x double")
    new = spark.createDataFrame([(2, "B", 3.0), (3, "c", 4.0)], rows.schema)
    content = lambda df: sorted(tuple(r) for r in df.collect())
    assert content(changes.upsert(rows, new, "id")) == [(1, "a", 1.0), (2, "B", 3.0), (3, "c", 4.0)]
    assert content(changes.upsert(rows, new, "id", "insert")) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 4.0)]
    assert content(changes.upsert(rows, new, "id", "update")) == [(1, "a", 1.0), (2, "B", 3.0)]
    feed = spark.createDataFrame([(1, None, None, "delete", 5), (2, "z", 9.0, "update", 3), (2, "y", 8.0, "update", 4), (4, "n", 1.0, "insert", 1)], "id long, name string, x double, op string, at long")
    assert content(changes.apply_changes(rows, feed, "id")) == [(2, "y", 8.0), (4, "n", 1.0)]
    versions = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("k", 3, False), ("l", 1, False)], "key string, at long, gone boolean")
    seen = lambda at: sorted(r.key for r in changes.snapshot(versions, "key", "at", F.col("gone"), at).collect())
    assert (seen(1), seen(2), seen(3)) == (["k", "l"], ["l"], ["k", "l"])
    assert changes.kept_versions(versions, "key", "at", 2).count() == 3


def test_collection(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    c = store.create("docs", Schema.default(3, "l2"))
    make = lambda *rows: spark.createDataFrame(rows, "id string, text string, vector array<double>")
    c.insert(make(("a", "one", [1.0, 2.0, 3.0]), ("b", "two", [4.0, 5.0, 6.0])))
    assert store.names() == ["docs"] and c.count() == 2 and c.get("b", "x").where("text is null").first().id == "x"
    assert [r.id for r in c.search([4, 5, 6], 1).collect()] == ["b"]
    c.write(make(("b", "TWO", [4.0, 5.0, 6.0]), ("c", "three", [7.0, 8.0, 9.0])))
    c.patch(spark.createDataFrame([("a", "ONE")], "id string, text string"))
    assert {r.id: r.text for r in c.rows().collect()} == {"a": "ONE", "b": "TWO", "c": "three"}
    assert c.delete(["a", "missing"]) == 1 and [r.id for r in c.page(1, 1).collect()] == ["b"]
    c.add_fields(Field("lang", "string", default="en"))
    assert c.schema.version == 2 and {r.lang for r in c.rows().collect()} == {"en"}
    assert c.create_index("hash", "text", unique=True).name == "docs_scalar_text" and c.stats()["documents"] == 2
    for bad in (lambda: c.create_index("btree", "text"), lambda: c.add_fields(Field("lang", "string")), lambda: store.create("docs", Schema.default(3)), lambda: c.insert(make(("z", "TWO", [1.0, 1.0, 1.0]))), lambda: c.insert(make(("z", "q", [1.0])).withColumn("odd", F.lit(1)))):
        with pytest.raises(ValueError):
            bad()
    for broken in (make(("z", "q", [1.0])), make((None, "q", [1.0, 1.0, 1.0]))):
        with pytest.raises(PySparkException):
            c.insert(broken)
    assert c.drop_index("docs_scalar_text") and not c.drop_index("docs_scalar_text")
    c.clear()
    assert c.count() == 0 and store.drop("docs") and not store.exists("docs")
    with pytest.raises(KeyError):
        store.get("docs")


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    for kind in ("json", "csv", "text", "parquet", "orc"):
        files.export(rows, f"file://{tmp_path}/{kind}", kind, codec="gzip" if kind in ("json", "csv") else None)
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2 and spark.read.text(f"file://{tmp_path}/text").first()[0] in ("1 a", "2 -")
    (tmp_path / "docs.json").write_text('[{"id": 1}, {"id": 2}]')
    assert files.read_documents(spark, f"file://{tmp_path}/docs.json").count() == 2
    full = files.backup(rows.withColumn("at", F.lit(1)), f"file://{tmp_path}/b", "full")
    more = files.backup(rows.where("id = 2").withColumns({"t": F.lit("new"), "at": F.lit(2)}), f"file://{tmp_path}/b", "inc", since=1, changed="at")
    assert {r.id: r.t for r in files.restore(spark, full, [more], "id", "at").collect()} == {1: "a", 2: "new"}
    assert files.savings(100, 25) == {"ratio": 4.0, "savings_percent": 75.0}


def test_streams_equal_tables(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    folder = f"file://{tmp_path}/events"
    # an entry of the far future closes all windows
    last = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp_ntz"))
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(f"{folder}/in")
    last.write.mode("append").parquet(f"{folder}/in2")
    names = {"tumbling": W.tumbling_counts, "sliding": W.sliding_latency, "sessions": W.session_counts}
    for name, run in names.items():
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in*")
        W.drain(run(stream), f"file://{tmp_path}/{name}")
        found = spark.read.parquet(f"file://{tmp_path}/{name}/out")
        wanted = run(events)
        assert found.where("start < timestamp_ntz'2029-01-01'").exceptAll(wanted.select(found.columns)).count() == 0
        assert wanted.count() == found.where("start < timestamp_ntz'2029-01-01'").count()


def test_change_stream(spark, tmp_path):
    folder = f"file://{tmp_path}"
    schema = "id long, x double, op string, at long"
    spark.createDataFrame([(1, 1.0, "insert", 1), (2, 2.0, "insert", 2), (1, 5.0, "update", 3)], schema).coalesce(1).write.parquet(f"{folder}/feed")
    sink = W.ChangeSink(f"{folder}/table")
    stream = W.stream(spark, f"{folder}/feed", schema)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(sink.version(0)).collect()) == [(1, 5.0), (2, 2.0)]
    sink(spark.createDataFrame([(2, None, "delete", 9)], schema), 1)
    sink(spark.createDataFrame([(2, None, "delete", 9)], schema), 1)
    assert [tuple(r) for r in spark.read.parquet(sink.version(1)).collect()] == [(1, 5.0)]
    assert W.buffer_health(96, 100) == "critical" and W.buffer_health(10, 100) == "healthy"
