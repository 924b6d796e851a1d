"""Codes behind a trained rotation, and balanced leaves, against plain computations."""

import numpy as np
import pytest

from meridian.operators import additive, balanced, rotated
from meridian.operators import quantize as qz
from meridian.shipping import ship


@pytest.fixture(scope="module")
def mixed(spark):
    """Vectors whose spread lies across the chunks: what a rotation can use."""
    ship(spark)
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = ((rng.normal(size=(600, 6)) * [4, 3, 0.3, 0.3, 0.1, 0.1]) @ turn).astype("f4").astype(float)
    rows = [(2 * i, r.tolist(), "x") for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, codes string").repartition(3).persist()


def test_a_pass_adds_up(mixed):
    x, vectors = mixed
    rng = np.random.default_rng(1)
    code = rotated.Code(np.linalg.qr(rng.normal(size=(6, 6)))[0], rng.normal(size=(3, 5, 2)))
    count, sums, total, n = rotated._pass(vectors, code)
    near = np.stack([((x @ code.rotation).reshape(600, 3, 2)[:, c, None] - code.books[c][None]).__pow__(2).sum(2).argmin(1) for c in range(3)], 1)
    decoded = np.concatenate([code.books[c][near[:, c]] for c in range(3)], 1) @ code.rotation.T
    assert n == 600 and total == pytest.approx(((x - decoded) ** 2).sum())
    for c in range(3):
        for k in range(5):
            assert count[c, k] == (near[:, c] == k).sum()
            assert sums[c, k] == pytest.approx(x[near[:, c] == k].sum(0))
    got = {r.vec_id // 2: r.codes for r in rotated.encode(vectors, code).collect()}
    assert all(got[i] == near[i].tolist() for i in range(600))


def test_rotation_lowers_the_error(spark, mixed):
    x, vectors = mixed
    turned, plain = (rotated.train(vectors, 6, 3, 8, 6, rotate=r) for r in (True, False))
    assert np.allclose(turned.rotation @ turned.rotation.T, np.eye(6), atol=1e-8) and np.allclose(plain.rotation, np.eye(6))
    assert rotated.error(vectors, turned) < 0.8 * rotated.error(vectors, plain)
    got = {r.vec_id: r.embedding for r in qz.rotate(vectors, turned.rotation).collect()}
    assert np.allclose(got[14], x[7] @ turned.rotation)
    none = rotated.encode(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"), turned).collect()
    assert [tuple(r) for r in none] == [(1, None)]


@pytest.mark.parametrize("task_rows", [60, 1 << 16])
def test_leaves_are_bounded(spark, task_rows):
    ship(spark)
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(size=(200, 3)), rng.normal(size=(150, 3)) * 0.01 + 9, np.ones((120, 3))))
    rows = [(i, r.tolist(), 7) for i, r in enumerate(x)] + [(900, None, 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int")
    leaves = balanced.balanced_leaves(vectors, 12, branch=4, task_rows=task_rows).collect()
    members = {}
    for r in leaves:
        members.setdefault(r.leaf, []).append(r.vec_id)
    assert sorted(r.vec_id for r in leaves) == list(range(470))
    assert max(map(len, members.values())) <= 12
    groups = [len({0 if i < 200 else 1 if i < 350 else 2 for i in m}) for m in members.values()]
    assert np.mean(np.array(groups) == 1) > 0.8
    table = spark.createDataFrame(leaves)
    for r in balanced.heads(table).collect():
        own = np.array(sorted(members[r.leaf]))
        y = x[own].astype("f4").astype(float)
        gap = ((y - y.mean(0)) ** 2).sum(1)
        assert r.n == len(own) and gap[list(own).index(r["head"])] == pytest.approx(gap.min(), abs=1e-9)
    assert balanced.balanced_leaves(vectors.limit(0), 5).isEmpty()


def test_additive_codes_are_settled(spark, mixed):
    x, vectors = mixed
    books = additive.train_books(vectors, 3, 6)
    got = {r.vec_id // 2: r.codes for r in additive.encode(vectors, books).collect()}
    codes = np.array([got[i] for i in range(600)])
    error = lambda c: ((x - books[np.arange(3)[None], c].sum(1)) ** 2).sum(1)
    now = error(codes)
    for b in range(3):
        for word in range(6):
            changed = codes.copy()
            changed[:, b] = word
            assert (error(changed) >= now - 1e-6).all()
    near = ((x[:, None] - books[0][None]) ** 2).sum(2).min(1)
    assert now.sum() < 0.5 * near.sum()
    assert additive.encode(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"), books).isEmpty()
    left = additive.left_over(vectors, additive.encode(vectors, books), additive.book_table(spark, books)).where("vec_id = 14").first()
    assert left.rest == pytest.approx((x[7] - books[np.arange(3), codes[7]].sum(0)).tolist())
