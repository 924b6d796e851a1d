"""Lists under a stream of changes against a dictionary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.errors import MeridianError
from meridian.shipping import ship
from meridian.streaming.maintain import Lists

SCHEMA = "vec_id long, embedding array<float>, deleted boolean"


def test_lists_follow_their_changes(spark, tmp_path):
    ship(spark)
    rng = np.random.default_rng(2)
    centroids = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in (3, 8, 9)], "centroid_id long, centroid array<double>")
    lists = Lists.create(centroids, str(tmp_path / "lists"), 5, 20, 4)
    model: dict[int, list] = {}

    def vector():
        return rng.normal(size=4).astype("f4").tolist()

    same = vector()
    batches = [
        [(i, vector(), False) for i in range(90)] + [(i, same, False) for i in range(500, 560)],
        [(i, None, True) for i in range(0, 80)] + [(7, vector(), False), (900, None, True)] + [(i, vector(), False) for i in range(85, 95)] * 2,
        [],
        [(i, None, True) for i in range(80, 600) if i not in (86, 87, 501)],
    ]
    for n, rows in enumerate(batches):
        changes = spark.createDataFrame(rows, SCHEMA)
        if n == 1:  # a batch that died before its commit
            changes.where("not deleted").select("vec_id", "embedding", F.lit(3).cast("long").alias("centroid_id")).write.parquet(f"{tmp_path}/lists/rows/version=2")
        assert lists.apply(changes, n) and not lists.apply(changes, n)
        last = {}
        for i, x, gone in rows:
            if not (i in last and last[i] is None):
                last[i] = None if gone else max(x, last.get(i) or x) if n != 1 else x
        for i, x in last.items():
            model.pop(i, None) if x is None else model.update({i: x})
        own = lists.rows().collect()
        assert {r.vec_id for r in own} == set(model) and len(own) == len(model)
        sizes = {r.centroid_id: r.n for r in lists.centroids().collect()}
        held = {}
        for r in own:
            held[r.centroid_id] = held.get(r.centroid_id, 0) + 1
            if r.vec_id < 500 and not 85 <= r.vec_id < 95:
                assert r.embedding == pytest.approx(model[r.vec_id])
        assert all(sizes[i] == held.get(i, 0) for i in sizes) and set(held) <= set(sizes)
        assert max(held.values()) <= 20 and (min(held.values()) >= 5 or len(held) == 1)
    assert lists.state() == (4, 3)
    with pytest.raises(MeridianError):
        Lists(spark, "x", 5, 9)
