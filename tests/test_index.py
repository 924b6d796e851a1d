"""The index API, graphs and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from meridian.errors import MeridianError
from meridian.index import VectorIndex
from meridian.operators import evaluate as ev
from meridian.operators import graph as g
from meridian.operators import ivf, kmeans
from meridian.operators import knn as nn
from meridian.sources import logs
from meridian.streaming import search as st


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(9).normal(size=(400, 8)).round(4)
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").persist()


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    return VectorIndex.build(points[1], str(tmp_path_factory.mktemp("index")), 12)


def test_search(spark, points, index):
    x, vectors = points
    found = index.search(x[:20], 5, ef_search=60).persist()
    asked = nn.as_queries(vectors.where("vec_id < 20"))
    assert ev.recall(found, nn.knn(asked, vectors, 5), 5).first()["recall"] > 0.9
    assert found.groupBy("query_id", "vec_id").count().where("count > 1").isEmpty()
    for r in found.collect():
        assert r.dist == pytest.approx(((x[r.query_id] - x[r.vec_id]) ** 2).sum(), abs=1e-5)


def test_recall_rises_with_ef(spark, points, index):
    x, vectors = points
    truth = nn.knn(nn.as_queries(vectors.where("vec_id < 40")), vectors, 5).persist()
    low, high = (ev.recall(index.search(x[:40], 5, ef_search=e), truth, 5).first()["recall"] for e in (5, 80))
    assert high >= low and high > 0.9
    pruned = index.search(x[:40], 5, ef_search=80, early_exit_policy="pruning")
    assert ev.recall(pruned, truth, 5).first()["recall"] > 0.6


def test_arrays_and_one_query(points, index):
    ids, dist = index.search_arrays(points[0][3], 4)
    assert ids.shape == dist.shape == (1, 4) and ids[0, 0] == 3


@pytest.mark.parametrize(("queries", "options"), [(np.zeros((0, 8)), {}), (np.zeros(3), {}), (np.zeros(8), {"topk": 0}), (np.zeros(8), {"ef_search": True}), (np.zeros(8), {"early_exit_policy": "x"}), (np.zeros((1, 2, 8)), {})])
def test_validation(index, queries, options):
    with pytest.raises(MeridianError):
        index.search(queries, **options)


def test_no_index(spark, tmp_path):
    with pytest.raises(MeridianError):
        VectorIndex.load(spark, str(tmp_path))


def test_add_and_delete(spark, points, tmp_path):
    x, vectors = points
    own = VectorIndex.build(vectors.where("vec_id < 100"), str(tmp_path / "i"), 8)
    own.add(vectors.where("vec_id between 100 and 120"))
    own.delete(spark.createDataFrame([(5,), (110,)], "vec_id long"))
    again = VectorIndex.load(spark, str(tmp_path / "i"))
    ids, _ = again.search_arrays(x[[5, 105, 110]], 3)
    assert ids[1, 0] == 105 and 5 not in ids and 110 not in ids


def test_changes_apply_in_their_order(spark, points, tmp_path):
    _, vectors = points
    rows = {r.vec_id: list(r.embedding) for r in vectors.where("vec_id < 30").collect()}
    schema = "vec_id long, embedding array<float>"
    own = VectorIndex.build(spark.createDataFrame(list(rows.items()), schema), str(tmp_path / "changes"), degree=8)
    own.delete(spark.createDataFrame([(7,)], "vec_id long"))
    own.add(spark.createDataFrame([(7, rows[7]), (5, [x + 100 for x in rows[5]])], schema))
    ids, distances = own.search_arrays([rows[7], rows[5]], topk=1, ef_search=20)
    assert ids[0, 0] == 7 and distances[0, 0] == 0
    assert ids[1, 0] != 5
    own.delete(spark.createDataFrame([(i,) for i in range(20)], "vec_id long"))
    ids, _ = own.search_arrays([rows[3]], topk=10, ef_search=2)
    assert sorted(ids[0]) == list(range(20, 30))  # more deleted around it than ef_search


def test_logs(spark):
    text = ["QPS: 1", "Engine Sweep: num_blocks=108 ef_search=9", "===== Engine Result =====", "num_blocks=216 pipe_width=2", "topk=10, pipe_width=3", "QPS: 5.0", "[Engine] BatchLatency(ms): avg=1.5 p99=4", "Recall @ 10: 0.5", "QPS: 9"]
    text += ["===== Engine Result =====", "QPS: 8.0", "Engine Sweep: batch=1", "===== Engine Result =====", "QPS: 6.0"]
    other = ["===== Bare one Result =====", "batch=3", "QPS: 2", "A b/c 2 1 2 3 4 5", "=== Tech-Analysis Samples ===", "  A b/c   2 1 2 3 4 5.5", "A b/c 2.5 1 2 3 4 5", "1 2 3 4 5 6 7", "Recall @ 1: 1"]
    lines = spark.createDataFrame([(s, i, t) for s, own in (("s", text), ("t", other)) for i, t in enumerate(own)], "stem string, line int, text string")
    got = {r.qps: (r.system, r.blocks, r.ef, r.pipe_width, r.recall, r.batch_p99) for r in logs.parse_points(lines).collect()}
    assert got == {5.0: ("Engine", 216, 9, 3, 0.5, 4.0), 6.0: ("Engine", 1, None, 1, None, None), 2.0: ("Bare", 3, None, 1, 1.0, None)}
    assert [tuple(r)[3:] for r in logs.parse_samples(lines).collect()] == [("A b/c", 2.0, 1.0, 2.0, 3.0, 4.0, 5.5)]


def test_repeated_queries_are_numbered_on(spark, points):
    asked = nn.as_queries(points[1].where("vec_id in (3, 8)"), 3)
    assert sorted((r.query_id, r["round"]) for r in asked.collect()) == [(3, 0), (8, 0), (12, 1), (17, 1), (21, 2), (26, 2)]


def test_pruning_rule(spark, points):
    _, vectors = points
    edges = g.exact_edges(vectors, 10).persist()
    kept = {}
    for r in g.prune(edges, vectors, 6).orderBy("src", "dist", "dst").collect():
        kept.setdefault(r.src, []).append(r.dst)
    x = points[0].astype("f4").astype(float)
    for src in range(0, 400, 37):
        expected = []
        for r in edges.where(F.col("src") == src).orderBy("dist", "dst").collect():
            if len(expected) < 6 and all(r.dist < ((x[r.dst] - x[s]) ** 2).sum() for s in expected):
                expected.append(r.dst)
        assert kept[src] == expected


def test_pruned_trace(spark):
    rows = [(0, s, min(s + 1, 3), 1.0, 2.0) for s in range(30)] + [(1, s, s, 1.0 / (s + 1), 2.0) for s in range(30)]
    trace = spark.createDataFrame(rows, "query_id long, step long, found long, top1 double, topk double")
    assert {r.query_id: r.stop_step for r in ev.prune_trace(trace).collect()} == {0: 10, 1: -1}


def test_clusters(spark, points):
    x, vectors = points
    centres = kmeans.kmeans(vectors, 10, 4)
    spread = lambda c: ((x[:, None] - c[None]) ** 2).sum(2).min(1).mean()
    assert spread(centres) < spread(x[:1]) and centres.shape == (10, 8)
    even = kmeans.assign_step(vectors, kmeans.kmeans(vectors, 10, 8, 0.3), np.zeros(10)).groupBy("centroid_id").count().agg(F.max("count")).first()[0]
    assert even < 120


def test_layout(spark):
    lists = spark.createDataFrame([(c, i) for i, c in enumerate([1, 0, 1, 0, 0])], "centroid_id long, vec_id long")
    got = {r.vec_id: (r.page, r.offset) for r in ivf.pages(lists, 2048).collect()}
    assert got == {1: (0, 0), 3: (0, 2048), 4: (1, 0), 0: (1, 2048), 2: (2, 0)}


def test_streams(spark, points, tmp_path):
    _, vectors = points
    nn.as_queries(vectors.where("vec_id < 6")).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("query_id long, q array<float>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    st.search_stream(stream, st.exact_search(vectors, 3), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 18 and out.where("rank = 1 and query_id = vec_id").count() == 6

    for i, rows in enumerate(["vec_id < 10", "vec_id = 3"]):
        vectors.where(rows).withColumn("deleted", F.lit(i == 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
    centroids = ivf.chosen_centroids(vectors, 100, 4)
    changes = spark.readStream.schema("vec_id long, embedding array<float>, deleted boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/changes")
    st.update_stream(changes, centroids, f"{tmp_path}/lists", f"{tmp_path}/c2").awaitTermination(120)
    lists = st.current_lists(spark.read.parquet(f"{tmp_path}/lists"))
    assert sorted(r.vec_id for r in lists.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    assert {r.action for r in st.rebalance(lists, 3, 5).collect()} <= {"merge", "split", "keep"}


def test_entry_without_the_llm_part(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith("meridian.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "meridian.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = set(__spark_entry__.queries())
    assert "knn_l2" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= names
