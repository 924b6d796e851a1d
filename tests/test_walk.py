"""Walks over a partitioned graph against a plain one in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import earlyexit, graph, knn, rank, walk
from meridian.shipping import ship

N, DIMS, K, EF, WIDTH = 240, 8, 5, 24, 3


@pytest.fixture(scope="module")
def world(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, DIMS)).astype("f4").astype(float)
    x[17] = x[18] = x[19]  # ties
    base = spark.createDataFrame([(3 * i, r.tolist(), "x") for i, r in enumerate(x)], "vec_id long, embedding array<float>, q string").persist()
    edges = graph.both_ways(graph.leaf_edges(base, 6, DIMS, 3, 40, 3), 6)
    nodes = graph.nodes(base, edges).persist()
    return x, base, nodes, {r.vec_id // 3: [n // 3 for n in r.neighbors or []] for r in nodes.collect()}


def plain(x, links, q, entry, rule=lambda step, quiet: False):
    d = ((x - q) ** 2).sum(1)
    beam, done, step, quiet, seen = [(d[entry], entry)], set(), 0, 0, None
    while True:
        new = [n for _, n in beam if n not in done][:WIDTH]
        if not new:
            break
        done |= set(new)
        step += 1
        best = [e for e, n in beam if n in done][:K]
        state = (len(best), best[0], best[-1])
        quiet = quiet + 1 if seen and not (state[0] > seen[0] or state[1] < seen[1] or state[2] < seen[2]) else 0
        seen = state
        near = {n for m in new for n in links[m]} - {n for _, n in beam}
        beam = sorted(beam + [(d[n], n) for n in near])[:EF]
        if rule(step, quiet):
            break
    return [n for _, n in beam if n in done][:K], step


@pytest.mark.parametrize("rule", [None, (4, 2)])
def test_walks_equal_plain_ones(spark, world, rule):
    x, base, nodes, links = world
    asked = knn.as_queries(base.where("vec_id % 20 = 0")).unionByName(spark.createDataFrame([(999, None)], "query_id long, q array<float>"))
    with walk.Graph(nodes, 5) as g:
        entries = walk.entry_of_all(asked, spark.createDataFrame([(21,)], "vec_id long")).unionByName(spark.createDataFrame([(0, -7)], "query_id long, vec_id long"))
        found = walk.walk(asked, g, entries, K, EF, WIDTH, walk.pruning(*rule) if rule else None)
    assert not [t for t in spark.catalog.listTables() if t.name == g.name]
    got = {}
    for r in found.results().orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id // 3)
    steps = {r.query_id: r.step for r in found.steps().collect()}
    for q in range(0, 3 * N, 60):
        expected = plain(x, links, x[q // 3], 7, (lambda s, c: s >= rule[0] and c >= rule[1]) if rule else (lambda s, c: False))
        assert (got[q], steps[q]) == expected
    assert 999 not in got


def test_rules_leave_early(spark, world):
    _, base, nodes, _ = world
    asked = knn.as_queries(base.where("vec_id % 20 = 0"))
    truth = knn.knn(asked, base, K).select("query_id", "vec_id").persist()
    entries = walk.entry_of_all(asked, graph.medoid_of(base))
    with walk.Graph(nodes) as g:
        full = walk.walk(asked, g, entries, K, EF, WIDTH, truth=truth)
        hits = walk.walk(asked, g, entries, K, EF, WIDTH, walk.enough_hits(4), truth)
        model = earlyexit.train(full.trace(), K, trees=3, depth=2)
        left = walk.walk(asked, g, entries, K, EF, WIDTH, earlyexit.predicted(model, 0.6), truth)
        none = walk.walk(asked.limit(0), g, entries, K, EF, WIDTH)
    assert none.results().isEmpty()
    steps = lambda w: w.steps().agg(F.sum("expanded")).first()[0]
    assert max(steps(hits), steps(left)) < steps(full)
    assert {r.stop: r.least for r in hits.steps().groupBy("stop").agg(F.min("hits").alias("least")).collect()}[True] == 4


def test_ranks_are_global(spark):
    rows = [(None if i % 11 == 0 else i % 7, i) for i in range(200)]
    table = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = {r.b: r["rank"] for r in rank.ranked(table, "a", F.desc("b")).collect()}
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert got == {b: i for i, (_, b) in enumerate(expected)}
    assert rank.ranked(table.limit(0), "a").isEmpty()


def test_beams_hold_no_neighbours_and_meet_no_more_than_they_hold(spark, monkeypatch):
    base = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<float>").persist()
    edges = base.where("vec_id > 0").selectExpr("0L AS src", "vec_id AS dst", "1.0D AS dist")  # a hub
    met, sizes = walk._met, []

    def seen(*args):
        out = met(*args)
        sizes.append(out.agg(F.max(F.size("near"))).first()[0])
        return out

    monkeypatch.setattr(walk, "_met", seen)
    asked = knn.as_queries(base.where("vec_id in (7, 250)"))
    with walk.Graph(graph.nodes(base, edges), 2) as g:
        found = walk.walk(asked, g, walk.entry_of_all(asked, base.where("vec_id = 0")), 3, 5, 2)
        assert "neighbors" not in found.rounds.schema.simpleString()
        got = sorted((r.query_id, r.rank, r.vec_id) for r in found.results().collect())
    assert got == [(7, 1, 7), (7, 2, 6), (7, 3, 8), (250, 1, 250), (250, 2, 249), (250, 3, 251)]
    assert max(s for s in sizes if s) == 5
