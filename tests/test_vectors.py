"""Column expressions against numpy, on vectors that aren't normalised."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import stats, vectors as v
from meridian.operators import evaluate as ev
from meridian.operators import knn as nn


def value(spark, f, a, b):
    rows = spark.createDataFrame([(list(map(float, a)), list(map(float, b)))], "a array<double>, b array<double>")
    return rows.select(f(F.col("a"), F.col("b")).alias("x")).first()[0]


@pytest.mark.parametrize("dims", [1, 7, 20, 150])
def test_distances(spark, dims):
    rng = np.random.default_rng(dims)
    a, b = rng.normal(size=dims) * 3, rng.normal(size=dims) - 1
    p, q = np.abs(a) + 0.1, np.abs(b) + 0.1
    m = (p + q) / 2
    expected = {
        v.squared_l2: ((a - b) ** 2).sum(),
        v.inner_product: a @ b,
        v.cosine_similarity: a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-6),
        v.l1: np.abs(a - b).sum(),
        v.l_infinity: np.abs(a - b).max(),
        v.canberra: (np.abs(a - b) / (np.abs(a) + np.abs(b))).sum(),
        v.bray_curtis: np.abs(a - b).sum() / np.abs(a + b).sum(),
        v.expanded_l2: ((a - b) ** 2).sum(),
    }
    for f, x in expected.items():
        assert value(spark, f, a, b) == pytest.approx(x, rel=1e-9)
    assert value(spark, v.jensen_shannon, p, q) == pytest.approx(0.5 * (-p * np.log(m / p) - q * np.log(m / q)).sum())
    assert value(spark, v.jaccard_similarity, p, q) == pytest.approx(np.minimum(p, q).sum() / np.maximum(p, q).sum())
    assert value(spark, lambda x, y: v.lp(x, y, 3), a, b) == pytest.approx((np.abs(a - b) ** 3).sum())


def test_zero_vectors(spark):
    zero = [0.0, 0.0]
    assert value(spark, v.cosine_similarity, zero, [1, 2]) == 0
    assert value(spark, v.canberra, zero, zero) == 0
    assert value(spark, v.bray_curtis, zero, zero) is None
    assert value(spark, v.jaccard_similarity, zero, zero) is None


def test_gower(spark):
    nan = float("nan")
    assert value(spark, v.gower, [0.2, -1, nan], [0.5, -2, 0.1]) == pytest.approx((0.3 + 1) / 2)
    assert value(spark, v.gower, [0.2, -1], [0.2, -1]) == 0
    assert math.isnan(value(spark, v.gower, [0.2], [-1]))
    assert math.isnan(value(spark, v.gower, [nan], [nan]))


def test_lengths_that_differ(spark):
    assert value(spark, v.squared_l2, [1, 2], [1]) is None


def test_reconstruct_and_code_distance(spark):
    row = spark.range(1).select(
        v.reconstruct(F.array(F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0))), F.array(F.array(F.lit(3.0)), F.array(F.lit(4.0)))), F.array(F.lit(1), F.lit(0))).alias("x"),
        v.code_distance(F.array(F.array(F.array(F.lit(0.0), F.lit(5.0)), F.array(F.lit(5.0), F.lit(0.0)))), F.array(F.lit(0)), F.array(F.lit(1)), 1).alias("d"),
    ).first()
    assert row["x"] == [2.0, 3.0] and row["d"] == 5.0


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_blocked_search_is_exact(spark, metric, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 9)) * 2
    x[50] = x[3]  # a tie
    q = np.concatenate((x[:5], rng.normal(size=(8, 9))))
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id long, q array<double>")
    monkeypatch.setattr(nn, "BLOCK_BYTES", 200)
    got = {(r.query_id, r.rank): (r.vec_id, r.dist) for r in nn.knn(queries, vectors, 7, metric).collect()}
    d = ((q[:, None] - x[None]) ** 2).sum(2) if metric == "l2" else nn.distances(q, x, metric)
    for i in range(len(q)):
        order = np.lexsort((np.arange(300), np.round(d[i], 9)))[:7]
        assert [got[i, r + 1][0] for r in range(7)] == order.tolist()
        assert [got[i, r + 1][1] for r in range(7)] == pytest.approx(d[i][order].tolist(), abs=1e-9)


def test_k_larger_than_the_corpus_and_no_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [0.0])], "query_id long, q array<double>")
    assert nn.knn(queries, vectors, 5).count() == 1
    assert nn.knn(queries.where("false"), vectors, 5).count() == 0
    assert nn.valid_candidates(spark.createDataFrame([(1,), (-1,), (None,)], "vec_id long")).count() == 1


def test_recall_golden(spark):
    results = spark.createDataFrame([(q, r + 1, i) for q, ids in enumerate([[1, 2, 3], [8, 9, 10]]) for r, i in enumerate(ids)], "query_id long, rank int, vec_id long")
    truth = spark.createDataFrame([(q, r + 1, i) for q, ids in enumerate([[3, 2, 1, 4], [7, 8, 11, 12]]) for r, i in enumerate(ids)], "query_id long, rank int, vec_id long")
    got = {r.query_id: (r.hits, r.recall) for r in ev.recall_by_query(results, truth, 3).collect()}
    assert got == {0: (3, 1.0), 1: (1, pytest.approx(1 / 3))}
    assert ev.recall(results, truth, 3).first()["recall"] == pytest.approx(4 / 6)


def test_cdf_golden(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, x double")
    assert [(r.x, r.p) for r in ev.cdf_points(rows, ["k"], "x", 5).orderBy("point").collect()] == [(0, 0.1), (2, 0.3), (4, 0.5), (6, 0.7), (8, 0.9)]


def test_completed_io_and_timeline_golden(spark):
    rows = spark.createDataFrame([(1000, 1500), (2000, 0), (3000, 3250), (4000, 3999)], "submit long, complete long")
    assert sorted(r.latency_us for r in ev.completed_latency(rows, "submit", "complete").collect()) == [0.25, 0.5]
    got = spark.range(1).select(*(c.alias(n) for n, c in zip("abcd", ev.block_timeline(F.lit(1000), F.lit(111000), F.lit(20000)), strict=True))).first()
    assert (got.a, got.b, got.c) == (110, 20, 90) and got.d == pytest.approx(18.18, abs=0.01)


def test_percentiles_have_no_interpolation(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("a", 3.0), ("a", None)], "k string, x double")
    got = stats.latency_summary(rows, ["k"], "x").first()
    values = sorted([*range(10), 3])
    assert (got["count"], got.p50, got.p90, got["max"]) == (11, values[5], values[9], 9)


def test_fronts_skip_what_is_no_number(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("s", 1.0, 10.0), ("s", 1.0, 12.0), ("s", 2.0, 11.0), ("s", nan, 99.0), ("s", 3.0, nan), ("s", 4.0, 13.0)], "k string, lat double, qps double")
    assert sorted((r.lat, r.qps) for r in ev.pareto(rows, ["k"], "lat", "qps").collect()) == [(1.0, 12.0), (4.0, 13.0)]
    assert ev.best_under(rows, ["k"], "lat", "qps", 3.0).first()["qps"] == 12
    assert ev.best_under(rows, ["k"], "lat", "qps", 0.5).first()["lat"] == 1
