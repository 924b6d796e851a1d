"""Stores of metadata, and cursors."""

import json
import struct

import numpy as np
import pytest

from meridian.errors import MeridianError
from meridian.index import VectorIndex
from meridian.operators import knn as nn
from meridian.operators.cursor import Cursor, IndexCursor
from meridian.shipping import ship
from meridian.sources import metadata


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def stored(spark, rows, path, **options):
    metadata.write_metadata(spark.createDataFrame(rows, "vec_id long, meta binary, extra string"), str(path), **options)
    return {r.vec_id: bytes(r.meta) for r in metadata.read_metadata(spark, str(path), 7).collect()}


@pytest.mark.parametrize("step", [1, 3])
def test_round_trip(spark, tmp_path, step):
    rows = [(i * step - 20, [None, b"", b"\x00\xff", "é".encode() * i][i % 4], "x") for i in range(50)]
    assert stored(spark, rows, tmp_path / "m", shard_rows=9) == {i: b or b"" for i, b, _ in rows}
    found = metadata.shards(str(tmp_path / "m"))
    assert len(found) > 2 and sum(s.rows for s in found) == 50
    for s in found:
        raw = (tmp_path / "m" / f"metaindex-{s.name}.bin").read_bytes()
        assert struct.unpack("<i", raw[:4])[0] == s.rows and len(raw) == 4 + 8 * (s.rows + 1)
        assert struct.unpack("<Q", raw[-8:])[0] == (tmp_path / "m" / f"meta-{s.name}.bin").stat().st_size
    asked = spark.createDataFrame([(i,) for i in [*range(-30, 140), None, 5, 5]], "vec_id long")
    kept = {i: b or b"" for i, b, _ in rows}
    for r in metadata.attach(asked, str(tmp_path / "m")).collect():
        assert (None if r.meta is None else bytes(r.meta)) == kept.get(r.vec_id)


def test_a_plain_pair_of_files(spark, tmp_path):
    parts = [b"one", b"", b"three"]
    (tmp_path / "meta.bin").write_bytes(b"".join(parts))
    (tmp_path / "metaindex.bin").write_bytes(struct.pack("<i4Q", 3, 0, 3, 3, 8))
    assert [(r.vec_id, bytes(r.meta)) for r in metadata.read_metadata(spark, str(tmp_path)).orderBy("vec_id").collect()] == list(enumerate(parts))
    (tmp_path / "metaindex.bin").write_bytes(struct.pack("<i3Q", 3, 0, 3, 3))
    with pytest.raises(MeridianError):
        metadata.shards(str(tmp_path))


def test_one_id_reads_its_own_bytes(spark, tmp_path, monkeypatch):
    stored(spark, [(i, b"m" * 1000, "") for i in range(100)], tmp_path / "m", shard_rows=1000)
    read, plain = [], metadata.files.read_range
    monkeypatch.setattr(metadata.files, "read_range", lambda *a: read.append(len(plain(*a))) or plain(*a))
    (shard,) = metadata.shards(str(tmp_path / "m"))
    read.clear()
    assert metadata._bytes_of(str(tmp_path / "m"), shard, np.array([42])) == {42: b"m" * 1000}
    assert sum(read) == 16 + 1000


def test_empty_twice_and_none(spark, tmp_path):
    assert stored(spark, [], tmp_path / "e") == {}
    assert metadata.attach(spark.createDataFrame([(1,)], "vec_id long"), str(tmp_path / "e")).first().meta is None
    with pytest.raises(MeridianError):
        stored(spark, [(None, b"x", "")], tmp_path / "n")
    with pytest.raises(Exception, match="twice"):
        stored(spark, [(1, b"x", ""), (1, b"y", "")], tmp_path / "t")
    with pytest.raises(MeridianError):
        metadata.shards(str(tmp_path / "nowhere"))


def test_pages_go_on_and_never_repeat(spark, tmp_path):
    x = np.random.default_rng(3).integers(0, 3, (200, 4)).astype(float)  # many ties and copies
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "vec_id long, embedding array<float>").repartition(5)
    asked = nn.as_queries(vectors.where("vec_id < 6"))
    cursor = Cursor.create(asked, str(tmp_path / "c"), vectors)
    for k in (1, 10, 4, 500, 3):
        cursor.next(k)
    # opened again after a page was broken off
    state = tmp_path / "c" / "state.json"
    state.write_text(json.dumps(cursor.pages()[:3]))
    cursor = Cursor(spark, str(tmp_path / "c"), vectors)
    assert cursor.next(500).count() == 6 * (200 - 15) and cursor.next(3).count() == 0
    got = sorted((r.query_id, r["rank"], r.vec_id, r.dist) for r in cursor.given().collect())
    d = ((x[:6, None] - x[None]) ** 2).sum(2)
    assert got == [(q, n + 1, int(i), float(d[q, i])) for q in range(6) for n, i in enumerate(np.lexsort((np.arange(200), d[q])))]
    with pytest.raises(MeridianError):
        cursor.next(0)
    with pytest.raises(MeridianError):
        Cursor(spark, str(tmp_path / "none"), vectors)


def test_index_with_metadata_and_iterator(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(300, 8)).round(4)
    vectors = spark.createDataFrame([(i, r.tolist(), f"v{i}") for i, r in enumerate(x)], "vec_id long, embedding array<float>, about string")
    index = VectorIndex.build(vectors, str(tmp_path / "i"), 12, metadata="about")
    pages = index.iterator(x[:5], str(tmp_path / "c"))
    first = pages.next(4)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, index.search(x[:5], 4).select(*first.columns).collect()))
    again = IndexCursor(spark, str(tmp_path / "c"), index)
    again.next(6)
    given = again.given()
    assert given.select("query_id", "vec_id").distinct().count() == given.count() == 50
    truth = nn.knn(nn.as_queries(vectors.where("vec_id < 5")), vectors, 10)
    assert given.join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"]).count() >= 45
    index.add(spark.createDataFrame([(7, x[7].tolist(), "new"), (1000, x[0].tolist(), "far")], vectors.schema), metadata="about")
    meta = {r.vec_id: r.meta and bytes(r.meta).decode() for r in index.with_metadata(spark.createDataFrame([(3,), (7,), (1000,), (77_777,)], "vec_id long")).collect()}
    assert meta == {3: "v3", 7: "new", 1000: "far", 77_777: None}
