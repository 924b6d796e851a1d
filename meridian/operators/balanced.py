"""Balanced hierarchical clustering: leaves of bounded size, and a head for each.

Leaves too large for a task are split in place, all of a level at once, by a
k-means of their own with a penalty on the size that a centre had; centres of as
many leaves as fit in CENTRE_BYTES are sent at a time. A leaf that fits in a task
is split there until none of its parts is larger than the bound. Vectors that no
centre tells apart are dealt evenly by a hash. Rows stay distributed throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import squared_l2
from ..scratch import cut
from .knn import ID, VECTOR, _matrix

#: Rows that a task splits by itself, bytes of centres sent at a time.
TASK_ROWS, CENTRE_BYTES = 1 << 16, 64 << 20
LEAF = "leaf"
_ROWS = f"{ID} long, {VECTOR} array<float>, {LEAF} long"


def _apart(x: np.ndarray, centres: np.ndarray, load: np.ndarray, balance: float) -> np.ndarray:
    """The centre of least distance, a crowded one counting as farther by a share of the mean distance to the nearest."""
    d = np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0)
    return (d + balance * d.min(1).mean() * load[None]).argmin(1)


def split_rows(x: np.ndarray, cap: int, branch: int, balance: float, rounds: int = 4) -> np.ndarray:
    """Leaf of each row, none with more than cap: the largest part is split until all are small enough."""
    parts, done = [np.arange(len(x))], []
    while parts:
        own = parts.pop()
        if len(own) <= cap:
            done.append(own)
            continue
        k = min(branch, -(-len(own) // cap) if len(own) > 2 * cap else 2)
        y = x[own]
        centres, load = y[np.linspace(0, len(y) - 1, k).astype(int)], np.zeros(k)
        for _ in range(rounds):
            label = _apart(y, centres, load, balance)
            count = np.bincount(label, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, label, y)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
            load = count / count.mean()
        if count.max() > 0.9 * len(y):
            label = np.arange(len(y)) % k
        parts += [own[label == i] for i in range(k) if (label == i).any()]
    out = np.empty(len(x), np.int64)
    for i, own in enumerate(sorted(done, key=lambda p: p[0])):
        out[own] = i
    return out


def _split_level(rows: DataFrame, large: list[int], dims: int, branch: int, balance: float, rounds: int, level: int) -> DataFrame:
    """Rows of some leaves with their child's number in place of their leaf's."""
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in large], f"{LEAF} long"))
    # in order of leaves, so that a task adds up few of them
    own = rows.join(wanted, LEAF, "left_semi").select(ID, VECTOR, LEAF, F.xxhash64(ID).alias("dealt_")).repartitionByRange(LEAF, "dealt_")
    own = cut(own.drop("dealt_"), "level")
    pick = F.row_number().over(Window.partitionBy(LEAF).orderBy(F.xxhash64(ID, F.lit(level)), ID))
    first = own.withColumn("pick", pick).where(F.col("pick") <= branch).collect()  # as many as centres
    place = {leaf: i for i, leaf in enumerate(large)}
    centres = np.zeros((len(large), branch, dims))
    size = np.zeros(len(large), int)
    for r in first:
        centres[place[r[LEAF]], r["pick"] - 1] = r[VECTOR]
        size[place[r[LEAF]]] += 1
    load = np.zeros((len(large), branch))

    def labelled(batch: pa.RecordBatch, state: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centres, load = state
        x, leaf = _matrix(batch.column(1)), np.array([place[i] for i in batch.column(2).to_pylist()], int)
        child = np.zeros(len(x), int)
        for i in np.unique(leaf):
            mine = leaf == i
            child[mine] = _apart(x[mine], centres[i, : size[i]], load[i, : size[i]], balance)
        return x, leaf, child

    count = np.zeros((len(large), branch))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((centres, load))

        def add(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums, count = np.zeros((len(large) * branch, dims)), np.zeros(len(large) * branch)
            for batch in batches:
                if batch.num_rows:
                    x, leaf, child = labelled(batch, held.value)
                    np.add.at(sums, leaf * branch + child, x)
                    count += np.bincount(leaf * branch + child, minlength=len(count))
            at = np.flatnonzero(count)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, dims + 1)), pa.array(np.tile(np.arange(dims + 1), len(at))), pa.array(np.concatenate((sums[at], count[at][:, None]), 1).ravel())], ["c", "d", "x"])

        table = own.mapInArrow(add, "c long, d long, x double").groupBy("c", "d").agg(F.sum("x").alias("x")).toArrow()
        total = np.zeros((len(large) * branch, dims + 1))
        total[table["c"].to_numpy(), table["d"].to_numpy()] = table["x"].to_numpy()
        count = total[:, -1].reshape(len(large), branch)
        mean = (total[:, :-1] / np.maximum(total[:, -1:], 1)).reshape(centres.shape)
        centres = np.where(count[:, :, None] > 0, mean, centres)
        load = count / np.maximum(count.sum(1, keepdims=True) / np.maximum(size, 1)[:, None], 1)
        held.unpersist()
    alike = set(np.flatnonzero(count.max(1) > 0.9 * count.sum(1)).tolist())
    held = spark.sparkContext.broadcast((centres, load))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, leaf, child = labelled(batch, held.value)
                turn = np.isin(leaf, list(alike))
                child[turn] = batch.column(3).to_numpy()[turn] % branch
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(large)[leaf] * branch + child + 1)], [ID, VECTOR, LEAF])

    dealt = F.pmod(F.xxhash64(ID, F.lit(-level - 1)), F.lit(1 << 30)).alias("dealt")
    return own.select(ID, VECTOR, LEAF, dealt).mapInArrow(move, _ROWS)


def balanced_leaves(vectors: DataFrame, cap: int, branch: int = 32, balance: float = 0.05, task_rows: int = TASK_ROWS, rounds: int = 4) -> DataFrame:
    """vec_id, embedding, leaf: each vector in one leaf, of cap vectors at most; leaves have numbers, not in a row. Null vectors are in none."""
    base = vectors.select(F.col(ID).cast("long").alias(ID), F.col(VECTOR).cast("array<float>").alias(VECTOR)).where(F.col(VECTOR).isNotNull())
    dims = base.agg(F.max(F.size(VECTOR))).first()[0] or 1
    rows, level = base.withColumn(LEAF, F.lit(0).cast("long")), 0
    while True:
        large = sorted(r[0] for r in rows.groupBy(LEAF).count().where(F.col("count") > task_rows).collect())
        if not large:
            break
        group = max(1, CENTRE_BYTES // (branch * dims * 8))
        parts = [_split_level(rows, large[i : i + group], dims, branch, balance, rounds, level) for i in range(0, len(large), group)]
        small = rows.join(F.broadcast(vectors.sparkSession.createDataFrame([(i,) for i in large], f"{LEAF} long")), LEAF, "left_anti").select(ID, VECTOR, LEAF)
        for part in parts:
            small = small.unionByName(part)
        rows, level = cut(small, "leaves"), level + 1

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(ID)
        own = split_rows(_matrix(table[VECTOR].combine_chunks()), cap, branch, balance)
        return pa.table({ID: table[ID], VECTOR: table[VECTOR], LEAF: pa.array((key[0].as_py() << 20) + own)})

    return rows.groupBy(LEAF).applyInArrow(finish, _ROWS)


def heads(leaves: DataFrame) -> DataFrame:
    """leaf, n, head: the member nearest to the mean of each leaf."""
    means = leaves.select(LEAF, F.posexplode(VECTOR).alias("d", "x")).groupBy(LEAF, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy(LEAF).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("mean"))
    near = leaves.join(means, LEAF)
    return near.groupBy(LEAF).agg(F.count("*").alias("n"), F.min_by(ID, F.struct(squared_l2(F.col(VECTOR), F.col("mean")), F.col(ID))).alias("head"))
