"""The command line, and the comparisons of benchmark points."""

import json
import os

import numpy as np
import pytest

from meridian.index import VectorIndex
from meridian.operators import ivf, knn as nn
from meridian.plans import bench
from meridian.search import main
from meridian.sources.vectors import read_vectors, write_vectors


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Base vectors, queries, their true neighbours, and an index of the base, all through files."""
    root = str(tmp_path_factory.mktemp("cli"))
    x = np.random.default_rng(2).normal(size=(300, 6)).astype(np.float32)
    q = x[::15] + np.float32(0.01)
    near = ((q[:, None].astype(float) - x[None]) ** 2).sum(-1).argsort(1, kind="stable")[:, :5]
    for name, rows, kind in (("base", x, "float32"), ("queries", q, "float32"), ("truth", near, "int32")):
        table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<int>" if kind == "int32" else "vec_id long, embedding array<float>")
        write_vectors(table, f"{root}/{name}.{'fbin' if name == 'queries' else 'bin'}", dtype=kind)
    assert main(["build", f"{root}/base.bin", f"{root}/index", "--dtype", "float32", "--degree", "12"], spark) == 0
    return root, near


def run(spark, capsys, *argv):
    code = main(argv, spark)
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_search_with_truth_repeats_and_results(spark, files, capsys):
    root, near = files
    code, got = run(spark, capsys, "search", f"{root}/index", f"{root}/queries.fbin", "--truth", f"{root}/truth.bin", "--topk", "5", "--ef", "40", "--repeat", "3", "--result-prefix", f"{root}/out", "--recall-csv", f"{root}/recall")
    assert code == 0 and got["queries"] == 60 and got["recall"] >= 0.9 and got["hits"] == round(got["recall"] * 300) and got["qps"] > 0
    ids = {r.vec_id: r.embedding for r in read_vectors(spark, f"{root}/out_ids.bin", dtype="int32").collect()}
    assert len(ids) == 60 and sum(len(set(ids[i]) & set(near[i % 20].tolist())) for i in ids) == got["hits"]
    each = spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/recall").collect()
    assert len(each) == 60 and sum(r.hits for r in each) == got["hits"]


def test_exact_search_sees_changes(spark, files, capsys):
    root, near = files
    code, got = run(spark, capsys, "search", f"{root}/index", f"{root}/queries.fbin", "--truth", f"{root}/truth.bin", "--topk", "5", "--exact")
    assert code == 0 and got["recall"] == 1.0
    main(["build", f"{root}/base.bin", f"{root}/changed", "--dtype", "float32"], spark)
    index = VectorIndex.load(spark, f"{root}/changed")
    index.delete(spark.createDataFrame([(int(i),) for i in set(near[:, 0].tolist())], "vec_id long"))
    code, got = run(spark, capsys, "search", f"{root}/changed", f"{root}/queries.fbin", "--truth", f"{root}/truth.bin", "--topk", "5", "--exact")
    lost = sum(int(i) in set(near[:, 0].tolist()) for i in near.ravel())
    assert got["hits"] == 100 - lost


def test_wrong_use_is_said(spark, files, capsys):
    root, _ = files
    assert run(spark, capsys, "search", f"{root}/nothing", f"{root}/queries.fbin")[0] == 2
    assert "dimensions" in run(spark, capsys, "search", f"{root}/index", f"{root}/truth.bin")[1]["error"]
    assert "truth" in run(spark, capsys, "search", f"{root}/index", f"{root}/queries.fbin", "--truth", f"{root}/truth.bin", "--topk", "6")[1]["error"]
    assert "truth" in run(spark, capsys, "search", f"{root}/index", f"{root}/queries.fbin", "--recall-csv", f"{root}/no")[1]["error"] and not os.path.exists(f"{root}/no")
    assert run(spark, capsys, "search", f"{root}/index", f"{root}/queries.fbin", "--repeat", "0")[0] == 2
    with pytest.raises(SystemExit):
        main(["search", f"{root}/index", f"{root}/queries.fbin", "--early-exit", "sometimes"], spark)


def test_compared_fronts_and_utilisation(spark):
    nan, inf = float("nan"), float("inf")
    ours = spark.createDataFrame([("d", 10.0, 1.0), ("d", 9.0, 2.0), ("d", 20.0, 3.0), ("d", 99.0, 11.0), ("d", nan, 0.1), ("d", 5.0, None), ("d", 0.0, 0.5)], "dataset string, qps double, p99_ms double")
    theirs = spark.createDataFrame([("d", 1.0, 50.0), ("d", 3.0, 60.0), ("d", 2.0, 70.0), ("d", inf, 1.0)], "dataset string, qps double, p99_ms double")
    got = {(r.side, r.qps) for r in bench.compared_fronts(ours, theirs, ["dataset"], "p99_ms", 10.0).collect()}
    assert got == {("ours", 10.0), ("ours", 20.0), ("theirs", 1.0), ("theirs", 3.0)}
    points = spark.createDataFrame([("s", 2, 1, 50.0), ("s", 2, 1, 60.0), ("s", 1, 2, 90.0), ("s", 3, 2, 70.0), ("s", 1, 1, None)], "system string, queries_per_block int, pipe_width int, active_mean double")
    assert {(r.q, r.active_mean) for r in bench.utilisation(points, ["system"]).collect()} == {(2, 60.0), (6, 70.0)}


def test_nearest_rows_are_kept_by_parts_of_queries():
    """Batch after batch, with the distance of the last row that is kept as a bound: as one search over all rows."""
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(11, 5)), rng.normal(size=(400, 5))
    x[300:320] = x[:20]  # ties
    kept = nn.Kept(6)
    for i in range(0, 400, 40):
        for a in range(0, 11, 4):
            some = slice(a, min(a + 4, 11))
            kept.add(some, nn._nearest(q[some], np.arange(i, i + 40), x[i : i + 40], 6, "l2", None, kept.limit(some)))
    got = {(r, i) for b in kept.batch(np.arange(11)) for r, i in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True)}
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    assert got == {(r, int(i)) for r in range(11) for i in np.lexsort((np.arange(400), d[r]))[:6]}


def test_lists_are_scanned_without_a_row_for_each_pair(spark):
    vectors = spark.createDataFrame([(i, [float(i), 0.0], i % 3) for i in range(60)], "vec_id long, embedding array<double>, label int")
    asked = nn.as_queries(vectors.where("vec_id % 20 = 0"))
    lists = ivf.build(vectors, ivf.label_centroids(vectors))
    found = ivf.search(asked, ivf.label_centroids(vectors), lists, 4, 3)
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "zip_with" not in found._jdf.queryExecution().toString()
    near = nn.within(asked, vectors, 4.0)
    assert "zip_with" not in near._jdf.queryExecution().toString()
    assert {(r.query_id, r.vec_id) for r in near.collect()} == {(i, j) for i in (0, 20, 40) for j in range(60) if (i - j) ** 2 <= 4}


def test_codes_are_scanned_by_tables_in_blocks(spark, monkeypatch):
    """The least sums of table entries, with lists and offsets and without, as brute force; no row for each pair."""
    rng = np.random.default_rng(9)
    luts, codes, owner = rng.normal(size=(7, 2, 4)), rng.integers(0, 4, (90, 2)), rng.integers(0, 3, 90)
    tables = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(luts)], "query_id long, lut array<array<double>>")
    coded = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "vec_id long, codes array<int>")
    lists = spark.createDataFrame([(int(c), i) for i, c in enumerate(owner)], "centroid_id long, vec_id long")
    probes = spark.createDataFrame([(q, c) for q in range(7) for c in range(3) if c != q % 3], "query_id long, centroid_id long")
    d = np.round(luts[:, 0][:, codes[:, 0]] + luts[:, 1][:, codes[:, 1]], 9)
    for bound in (1 << 20, 200):
        monkeypatch.setattr(ivf, "BLOCK_BYTES", bound)
        for rows, wanted in ((ivf.scan_tables(tables, coded, 5), d), (ivf.scan_codes(probes, tables, lists, coded, 5, 9), np.where(owner[None] == np.arange(7)[:, None] % 3, np.inf, d))):
            assert "adc" not in rows._jdf.queryExecution().toString() and "zip_with" not in rows._jdf.queryExecution().toString()
            got = {(r.query_id, r.rank): r.vec_id for r in rows.collect()}
            assert got == {(q, r + 1): int(i) for q in range(7) for r, i in enumerate(np.lexsort((np.arange(90), wanted[q]))[:5])}


def test_every_pair_in_parts(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    rows = nn.every_pair(nn.as_queries(vectors.where("vec_id < 3")), vectors, ["dot"], lambda q, x: [q @ x.T])
    assert {(r.query_id, r.vec_id, r.dot) for r in rows.collect()} == {(i, j, i * j + 1.0) for i in range(3) for j in range(30)}
