"""Offline jobs that are killed, and sweeps that are interrupted."""

import numpy as np
import pytest

from meridian.errors import MeridianError
from meridian.operators import knn as nn
from meridian.plans.offline import OfflineJob
from meridian.sources import recovery
from meridian.sources.text import append_csv


@pytest.fixture(scope="module")
def vectors(spark):
    # a third of all rows are copies of one vector
    x = np.random.default_rng(5).normal(size=(300, 6)).round(3)
    x[::3] = x[0]
    return spark.createDataFrame([(3 * i, r.tolist()) for i, r in enumerate(x)] + [(5000, None)], "vec_id long, embedding array<float>").repartition(3).persist()


def test_lists_hold_all_and_all_probes_are_exact(spark, vectors, tmp_path):
    job = OfflineJob(vectors, str(tmp_path / "j"), lists=6, nprobe=6, k=7, slice_rows=40, block_rows=30)
    got = sorted(map(tuple, job.search()[0].select("query_id", "rank", "vec_id", "dist").collect()))
    want = sorted(map(tuple, nn.knn(nn.as_queries(vectors), vectors, 7).select("query_id", "rank", "vec_id", "dist").collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])
    checks = {r.check: (r["rows"], r.bad) for r in job.run().collect()}
    slices = checks.pop("slices")
    assert checks == {"lists": (300, 0), "ranks": (300, 0), "distances": (2100, 0), "self": (300, 0)} and slices[0] >= 8 and not slices[1]


def test_fewer_probes_are_the_lists_they_name(spark, vectors, tmp_path):
    job = OfflineJob(vectors, str(tmp_path / "j"), lists=6, nprobe=2, k=5, slice_rows=40, block_rows=30)
    found = job.search()[0].collect()
    centres = {r.list_id: np.array(r.centroid) for r in job.train()[0].collect()}
    x = {r.vec_id: np.array(r.embedding) for r in vectors.where("embedding is not null").collect()}
    own = {r.vec_id: r.list_id for r in job.shard()[0].collect()}
    for q in list(x)[::17]:
        near = sorted(centres, key=lambda c: ((x[q] - centres[c]) ** 2).sum())[:2]
        d = sorted((((x[q] - x[i]) ** 2).sum(), i) for i in x if own[i] in near)[:5]
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in d]


def test_a_killed_job_goes_on(spark, vectors, tmp_path, monkeypatch):
    settings = dict(lists=4, nprobe=2, k=3, query_rows=110)
    job = OfflineJob(vectors, str(tmp_path / "j"), **settings)
    found, calls = OfflineJob._found, []

    def killed(self, *args):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return found(self, *args)

    monkeypatch.setattr(OfflineJob, "_found", killed)
    with pytest.raises(KeyboardInterrupt):
        job.run()
    assert job.made == ["train", "shard", "search-0"]
    (tmp_path / "j" / "manifest-000099.json").write_text('{"train": ')  # broken off
    again = OfflineJob(vectors, str(tmp_path / "j"), **settings)
    assert all(r.bad == 0 for r in again.run().collect()) and again.made == ["search-1", "search-2", "check"]
    again = OfflineJob(vectors, str(tmp_path / "j"), **settings | {"nprobe": 3})
    again.run()
    assert again.made == ["search-0", "search-1", "search-2", "check"]
    again = OfflineJob(vectors.where("vec_id > 0"), str(tmp_path / "j"), **settings)
    again.train()
    assert again.made == ["train"]


def test_a_fault_is_counted(spark, vectors, tmp_path):
    job = OfflineJob(vectors, str(tmp_path / "j"), lists=4, nprobe=2, k=3)
    found, before = job.search()
    wrong = found.selectExpr("query_id", "rank", "vec_id", "case when query_id = 3 then dist + 1 else dist end dist").where("query_id <> 6 or rank <> 2")
    job.search = lambda: (wrong, before)
    assert {r.check: r.bad for r in job.run().collect()} == {"lists": 0, "slices": 0, "ranks": 1, "distances": 3, "self": 1}
    with pytest.raises(MeridianError):
        OfflineJob(vectors, str(tmp_path / "k"), lists=0, nprobe=1)


def written(spark, rows, schema, path):
    append_csv(spark.createDataFrame(rows, schema).coalesce(1), str(path))


def read(spark, path):
    return sorted((tuple(r) for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path)).collect()), key=str)


@pytest.fixture
def sweep(spark, tmp_path):
    folder = tmp_path / "out"
    written(spark, [("a", "1", "x"), ("b", "9", "line\nbreak")], "stem string, ef string, note string", folder / "metrics")
    written(spark, [("a", 1)], "stem string, v int", folder / "samples")
    grown = next((folder / "samples").glob("part*"))
    recovery.snapshot(str(folder), str(tmp_path / "state"))
    written(spark, [("a", "2", "y"), ("a", "3", "z"), (None, "3", "n"), ("a", None, "m")], "stem string, ef string, note string", folder / "metrics")
    written(spark, [("a", 2)], "stem string, v int", folder / "samples")
    written(spark, [("new", 3)], "stem string, v int", folder / "late")
    with grown.open("a") as f:
        f.write("a,7\n")
    (grown.parent / f".{grown.name}.crc").unlink(missing_ok=True)  # of the file as Spark wrote it
    return folder, str(tmp_path / "state")


def test_rows_of_points_that_did_not_end_go(spark, sweep):
    folder, state = sweep
    assert recovery.recover(spark, str(folder), state, "a", "ef", [1, "2"]) == {"late": "shortened", "metrics": "filtered", "samples": "shortened"}
    rest = read(spark, folder / "metrics"), read(spark, folder / "samples")
    assert sorted(rest[0], key=str) == sorted([("a", "1", "x"), ("b", "9", "line\nbreak"), ("a", "2", "y"), (None, "3", "n")], key=str) and rest[1] == [("a", "1")]
    aside = sorted(p.read_text() for p in folder.glob(".unassigned-*/samples/*.raw"))
    assert len(aside) == 2 and any("a,7" in t for t in aside) and len(list(folder.glob(".unassigned-*/late/*.raw"))) == 1
    assert set(recovery.recover(spark, str(folder), state, "a", "ef", [1, "2"]).values()) == {"kept"}


def test_all_done_keeps_samples_and_a_broken_swap_is_mended(spark, sweep):
    folder, state = sweep
    (folder / "metrics").rename(folder / ".old-metrics")
    assert recovery.recover(spark, str(folder), state, "a", "ef", [1, 2, 3], all_done=True) == {"late": "kept", "metrics": "filtered", "samples": "kept"}
    assert len(read(spark, folder / "samples")) == 3 and len(list(folder.glob(".old-*"))) == 0
    assert recovery.recover(spark, str(folder), state, "zzz", "ef", []) == {"late": "shortened", "metrics": "kept", "samples": "shortened"}
