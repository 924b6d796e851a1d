"""K-means over distributed vectors, balanced if asked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double
from .knn import ID, VECTOR, _matrix


def sample_rows(vectors: DataFrame, n: int) -> DataFrame:
    """About n rows at most, the same ones every time: those with the smallest hash of their id."""
    rows = vectors.count()
    if rows <= n:
        return vectors
    return vectors.where(F.pmod(F.xxhash64(ID), F.lit(1 << 30)) < int((1 << 30) * n / rows))


def lloyd(x: np.ndarray, k: int, iterations: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of a sample in memory."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].astype(float)
    label = np.zeros(len(x), int)
    for _ in range(iterations):
        label = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        count = np.bincount(label, minlength=k)
        sums = np.stack([np.bincount(label, x[:, d], k) for d in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres, ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def _parts(batch: pa.RecordBatch, centres: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts whose distances from all centres are 2^22 numbers or so."""
    rows = max(1, (1 << 22) // centres)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def assign_step(vectors: DataFrame, centres: np.ndarray, penalty: np.ndarray) -> DataFrame:
    """vec_id, centroid_id, dist: the centre of least distance plus penalty; the smaller number among equals."""
    held = vectors.sparkSession.sparkContext.broadcast((np.asarray(centres, float), np.asarray(penalty, float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, penalty = held.value
        for batch in (part for whole in batches for part in _parts(whole, len(centres))):
            x = _matrix(batch.column(1))
            d = np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0)
            best = (d + penalty[None]).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(d[np.arange(len(best)), best])], [ID, "centroid_id", "dist"])

    return vectors.select(F.col(ID).cast("long").alias(ID), as_double(F.col(VECTOR)).alias(VECTOR)).mapInArrow(run, f"{ID} long, centroid_id long, dist double")


def _sums(vectors: DataFrame, centres: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of each centre's vectors: a row a task and centre is shuffled."""
    held = vectors.sparkSession.sparkContext.broadcast((centres, penalty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, penalty = held.value
        sums, count = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for part in (part for whole in batches for part in _parts(whole, len(centres))):
            x = _matrix(part.column(0))
            best = ((centres * centres).sum(1)[None] - 2 * x @ centres.T + penalty[None]).argmin(1)
            np.add.at(sums, best, x)
            count += np.bincount(best, minlength=len(centres))
        own = np.flatnonzero(count)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[own]), pa.array(sums[own].tolist(), pa.list_(pa.float64()))], ["c", "n", "s"])

    parts = vectors.select(as_double(F.col(VECTOR)).alias(VECTOR)).mapInArrow(run, "c long, n long, s array<double>")
    rows = parts.select("c", "n", F.posexplode("s").alias("d", "x")).groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()
    sums, count = np.zeros(centres.shape), np.zeros(len(centres))
    c, d = rows["c"].to_numpy(), rows["d"].to_numpy()
    sums[c, d], count[c] = rows["x"].to_numpy(), rows["n"].to_numpy()
    return sums, count


def kmeans(vectors: DataFrame, k: int, iterations: int = 10, balance: float = 0.0, seed: int = 0, sample: int = 20_000) -> np.ndarray:
    """Centres of all vectors: started on a bounded sample, refined on every row.

    balance: added to a centre's distance for each vector it had in the round
    before, as a share of the mean cluster, so that clusters even out.
    """
    start = sample_rows(vectors.select(ID, VECTOR), sample).orderBy(ID).limit(2 * sample)
    x = _matrix(start.select(as_double(F.col(VECTOR)).alias(VECTOR)).toArrow()[VECTOR].combine_chunks())
    centres = lloyd(x, min(k, len(x)), 3, seed)[0]
    penalty = np.zeros(len(centres))
    for _ in range(iterations):
        sums, count = _sums(vectors, centres, penalty)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        penalty = balance * count / max(count.mean(), 1)
    return centres


def extremes(assigned: DataFrame) -> DataFrame:
    """centroid_id, n, nearest, farthest member of each cluster."""
    return assigned.groupBy("centroid_id").agg(F.count("*").alias("n"), F.min_by(ID, F.struct("dist", ID)).alias("nearest"), F.max_by(ID, F.struct(F.col("dist"), -F.col(ID))).alias("farthest"))
