"""Files: round trips, and headers that are broken."""

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException

from meridian.errors import MeridianError
from meridian.shipping import ship
from meridian.sources import indexes, text, vectors


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


@pytest.mark.parametrize(("suffix", "values"), [("fbin", [0.5, -2.0, 3.25]), ("u8bin", [0, 200, 255]), ("i8bin", [-128, 0, 127]), ("ibin", [-1, 1 << 20, 3])])
def test_round_trip(spark, tmp_path, suffix, values):
    rows = spark.createDataFrame([(i, [x for x in values]) for i in range(11)], f"vec_id long, embedding array<{'double' if suffix == 'fbin' else 'long'}>")
    path = f"{tmp_path}/x.{suffix}"
    vectors.write_vectors(rows, path, 3)
    assert struct.unpack("<ii", open(path, "rb").read(8)) == (11, 3)
    got = vectors.read_vectors(spark, path, rowsPerTask=4)
    assert got.rdd.getNumPartitions() == 3
    assert [(r.vec_id, r.embedding) for r in got.orderBy("vec_id").collect()] == [(i, values) for i in range(11)]


def test_xvecs(spark, tmp_path):
    path = f"{tmp_path}/a.fvecs"
    open(path, "wb").write(b"".join(struct.pack("<i2f", 2, i, -i) for i in range(5)))
    assert [r.embedding for r in vectors.read_vectors(spark, path).orderBy("vec_id").collect()] == [[i, -i] for i in range(5)]
    open(path, "ab").write(b"x")
    with pytest.raises(PySparkException):
        vectors.read_vectors(spark, path).count()


@pytest.mark.parametrize("content", [b"", b"\1\0\0\0", struct.pack("<ii", 5, 2) + b"\0" * 8])
def test_broken_headers(spark, tmp_path, content):
    path = f"{tmp_path}/b.fbin"
    open(path, "wb").write(content)
    with pytest.raises(PySparkException):
        vectors.read_vectors(spark, path).count()


def test_results_and_truth(spark, tmp_path):
    results = spark.createDataFrame([(0, 1, 5, 0.5), (0, 2, 6, 1.5), (1, 1, 7, 2.5)], "query_id long, rank int, vec_id long, dist double")
    vectors.write_results(results, f"{tmp_path}/r", 2)
    got = vectors.read_truth(spark, f"{tmp_path}/r_ids.bin")
    assert sorted(map(tuple, got.collect())) == [(0, 1, 5), (0, 2, 6), (1, 1, 7), (1, 2, -1)]
    dist = vectors.read_vectors(spark, f"{tmp_path}/r_distances.bin", dtype="float32").orderBy("vec_id").collect()
    assert dist[1].embedding == [2.5, float("inf")]


def test_graph_index(spark, tmp_path):
    nodes = [(np.arange(4) + i, [(i + 1) % 200, (i + 2) % 200][: 1 + i % 2]) for i in range(200)]
    path = f"{tmp_path}/t_disk.index"
    indexes.write_graph(path, nodes, "uint8", 3, 2)
    head = indexes.read_header(path)
    assert (head.vectors, head.dims, head.medoid, head.degree(1)) == (200, 4, 3, 2)
    got = {r.vec_id: (r.embedding, r.neighbors) for r in indexes.read_graph(spark, path, "uint8", 1).collect()}
    assert len(got) == 200 and all(got[i] == (list(map(float, (np.arange(4) + i) % 256)), n) for i, (_, n) in enumerate(nodes))
    assert indexes.discover(str(tmp_path))["index"] == path
    (tmp_path / "u_disk.index").write_bytes(b"")
    with pytest.raises(MeridianError):
        indexes.discover(str(tmp_path))


def test_pivots_and_navigation(tmp_path):
    pivots, centre, chunks = np.random.rand(256, 6).astype("f4"), np.random.rand(6).astype("f4"), np.array([0, 3, 6])
    indexes.write_pivots(f"{tmp_path}/p.bin", pivots, centre, chunks)
    got = indexes.read_pivots(f"{tmp_path}/p.bin")
    assert all(np.array_equal(a, b) for a, b in zip(got, (pivots, centre, chunks), strict=True))
    (tmp_path / "nav_index.data").write_bytes(struct.pack("<ii4f", 2, 2, 1, 2, 3, 4))
    (tmp_path / "map.txt").write_text("10\n20\n")
    (tmp_path / "nav_index").write_bytes(struct.pack("<6i", 0, 0, 0, 0, 2, 1) + struct.pack("<2i", 1, 1) + struct.pack("<2i", 1, 0))
    vectors_, base, near, start = indexes.read_nav(str(tmp_path), "float32")
    assert vectors_.tolist() == [[1, 2], [3, 4]] and base == [10, 20] and near == [[1], [0]] and start == 1


def test_text(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a\t1|2.5\nb\t3|4\n")
    assert [(r.meta, r.embedding) for r in text.read_text_vectors(spark, str(tmp_path / "v.txt")).collect()] == [("a", [1, 2.5]), ("b", [3, 4])]
    (tmp_path / "m.csv").write_text("k,x\na,1.5\nb,oops\n")
    got = {r.k: r.x for r in text.read_tolerant_csv(spark, str(tmp_path / "m.csv"), ["x"]).collect()}
    assert got["a"] == 1.5 and got["b"] != got["b"]
