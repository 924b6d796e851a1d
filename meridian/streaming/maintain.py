"""Lists of an inverted file kept in bounds under a stream of changes.

Every batch takes its changes into the lists of their nearest centroids. A list
that outgrows ``most`` is cut along its widest dimension into even parts, which
get centroids of their own; one that falls under ``least`` gives its centroid up.
Then the vectors of these lists and of the ``near`` lists around them go to the
nearest centroid among them, and what that leaves out of bounds is merged into
the nearest list or cut evenly, without moving others.

Lists are versioned: a batch writes the lists it touched as a new version, and a
small table of centroids says which version holds each list. A version counts
once its commit is there, with its batch's number: a batch that is replayed
finds its number committed and changes nothing, and one that died half-way is
written anew. Vectors stay in tables throughout; the driver holds centroids, up
to CENTROID_BYTES of them, and sends them to executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import MeridianError
from ..operators.ivf import CENTROID
from ..operators.knn import ID, VECTOR, _matrix
from ..operators.rank import ranked
from ..scratch import cut

CENTROID_BYTES = 256 << 20
_LISTED = f"{ID} long, {VECTOR} array<float>, {CENTROID} long"


def nearest_list(rows: DataFrame, numbers: np.ndarray, centres: np.ndarray) -> DataFrame:
    """vec_id, embedding, centroid_id: the list of the nearest centre, the smaller number among equals."""
    held = rows.sparkSession.sparkContext.broadcast((numbers, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centres = held.value
        norms = (centres * centres).sum(1)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                best = (norms[None] - 2 * _matrix(part.column(1)) @ centres.T).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers[best])], [ID, VECTOR, CENTROID])

    return rows.select(F.col(ID).cast("long").alias(ID), F.col(VECTOR).cast("array<float>").alias(VECTOR)).mapInArrow(run, _LISTED)


def cut_lists(rows: DataFrame, parts: dict[int, int]) -> DataFrame:
    """vec_id, embedding, centroid_id, part: each list in so many even parts along its widest dimension."""
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(parts.items()), f"{CENTROID} long, parts long"))  # lists that are cut: as many as centroids at most
    own = rows.join(wanted, CENTROID)
    spread = own.select(CENTROID, F.posexplode(VECTOR).alias("d", "x")).groupBy(CENTROID, "d").agg(F.var_pop("x").alias("spread"))
    widest = spread.groupBy(CENTROID).agg(F.max_by("d", F.struct("spread", -F.col("d"))).alias("d"))
    placed = own.join(F.broadcast(widest), CENTROID).withColumn("along", F.get(VECTOR, F.col("d")))
    order = ranked(placed.select(ID, VECTOR, CENTROID, "parts", "along"), CENTROID, "along", ID)
    ends = order.groupBy(CENTROID).agg(F.min("rank").alias("start"), F.count("*").alias("n"))
    part = F.floor((F.col("rank") - F.col("start")) * F.col("parts") / F.col("n")).cast("long")
    return order.join(F.broadcast(ends), CENTROID).select(ID, VECTOR, CENTROID, part.alias("part"))


class Lists:
    """Versioned lists at a path; least <= most / 2."""

    def __init__(self, spark: SparkSession, path: str, least: int, most: int, near: int = 64):
        if not 0 < least <= most // 2:
            raise MeridianError("least must be positive and most at least twice as large")
        self.spark, self.path, self.least, self.most, self.near = spark, path.rstrip("/"), least, most, near

    @classmethod
    def create(cls, centroids: DataFrame, path: str, least: int, most: int, near: int = 64) -> Lists:
        """Empty lists; centroids: centroid_id, centroid."""
        own = cls(centroids.sparkSession, path, least, most, near)
        rows = centroids.select(F.col(CENTROID).cast("long").alias(CENTROID), F.col("centroid").cast("array<double>").alias("centroid"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
        own._commit(0, -1, rows, own.spark.createDataFrame([], _LISTED))
        return own

    def _commit(self, version: int, batch: int, centroids: DataFrame, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/version={version}")
        centroids.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids/version={version}")
        self.spark.createDataFrame([(version, batch)], "number long, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/version={version}")

    def state(self) -> tuple[int, int]:
        """The last committed version and batch."""
        rows = self.spark.read.schema("number long, batch long").parquet(f"{self.path}/commits/*")
        return tuple(rows.agg(F.max(F.struct("number", "batch")).alias("x")).select("x.*").first())

    def centroids(self) -> DataFrame:
        """centroid_id, centroid, n, at: lists, their sizes, and the versions that hold them."""
        return self.spark.read.parquet(f"{self.path}/centroids/version={self.state()[0]}")

    def rows(self, only: list[int] | None = None) -> DataFrame:
        """vec_id, embedding, centroid_id of all lists, or of some."""
        lists = self.centroids().select(CENTROID, F.col("at").alias("version"))
        if only is not None:
            lists = lists.join(F.broadcast(self.spark.createDataFrame([(i,) for i in only], f"{CENTROID} long")), CENTROID, "left_semi")
        every = self.spark.read.schema(f"{_LISTED}, version long").option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return every.join(lists, [CENTROID, "version"], "left_semi").select(ID, VECTOR, CENTROID)

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Take a batch of vec_id, embedding, deleted; False if it was taken before. Within a batch a delete is the last change of its id."""
        version, last = self.state()
        if batch <= last:
            return False
        table = self.centroids().orderBy(CENTROID).toArrow()  # checked below
        numbers, centres = table[CENTROID].to_numpy(), np.array(table["centroid"].to_pylist(), float)
        if centres.nbytes > CENTROID_BYTES:
            raise MeridianError("too many lists for one level: let them hold more")
        size, at = dict(zip(numbers.tolist(), table["n"].to_pylist(), strict=True)), dict(zip(numbers.tolist(), table["at"].to_pylist(), strict=True))
        centre = dict(zip(numbers.tolist(), centres, strict=True))
        order = F.struct("deleted", F.xxhash64(VECTOR))
        changed = cut(changes.groupBy(F.col(ID).cast("long").alias(ID)).agg(F.max_by(F.struct(F.col(VECTOR).cast("array<float>").alias(VECTOR), "deleted"), order).alias("x")).select(ID, f"x.{VECTOR}", "x.deleted"), "changes")
        fresh = cut(nearest_list(changed.where("not deleted and embedding is not null"), numbers, centres), "fresh")
        lost = self.rows().select(ID, CENTROID).join(changed.select(ID), ID, "left_semi").select(CENTROID)
        touched = {r[0] for r in lost.union(fresh.select(CENTROID)).distinct().collect()}  # lists, not vectors

        def loaded(lists: set[int]) -> DataFrame:
            return self.rows(sorted(lists)).join(changed.select(ID), ID, "left_anti")

        def counted(rows: DataFrame) -> dict[int, int]:
            return {r[0]: r["count"] for r in rows.groupBy(CENTROID).count().collect()}

        work = cut(loaded(touched).unionByName(fresh), "work")
        now = counted(work)
        over = {i for i in touched if now.get(i, 0) > self.most}
        small = {i for i in touched if now.get(i, 0) < self.least}
        around = self._around(over | small, centre) - touched
        if around:
            work = work.unionByName(self.rows(sorted(around)))
        affected = touched | around
        following = max(centre, default=-1) + 1
        if over:
            following = self._split(work, {i: -(-now[i] * 10 // (7 * self.most)) for i in over}, centre, affected, following)[1]
        keep = sorted(affected - small) or sorted(affected)[:1]
        if over or small:  # otherwise every vector is where it belongs
            work = cut(nearest_list(work, np.array(keep), np.stack([centre[i] for i in keep])), "moved")
            for i in affected - set(keep):
                del centre[i]
            affected = set(keep)
        # what is still out of bounds: merged into the nearest list, then cut
        now = {i: 0 for i in affected} | counted(work)
        into = {}
        for i in sorted(affected, key=lambda i: (now[i], i)):
            others = [j for j in affected if j not in into and j != i]
            if now[i] < self.least and others:
                to = min(others, key=lambda j: (((centre[i] - centre[j]) ** 2).sum(), j))
                into[i] = to
                now[to] += now.pop(i)
        if into:
            def final(i: int) -> int:
                while i in into:
                    i = into[i]
                return i

            moves = F.broadcast(self.spark.createDataFrame([(i, final(i)) for i in into], f"{CENTROID} long, into long"))
            work = work.join(moves, CENTROID, "left").select(ID, VECTOR, F.coalesce("into", CENTROID).alias(CENTROID))
            for i in into:
                del centre[i]
                affected.discard(i)
        over = {i for i in affected if now[i] > self.most}
        if over:
            parts, _ = self._split(work, {i: -(-now[i] // self.most) for i in over}, centre, affected, following)
            rest = work.join(F.broadcast(self.spark.createDataFrame([(i,) for i in over], f"{CENTROID} long")), CENTROID, "left_anti")
            work = cut(rest.unionByName(parts), "cut")
            now = counted(work)
        size |= {i: now.get(i, 0) for i in affected}
        at |= dict.fromkeys(affected, version + 1)
        lists = self.spark.createDataFrame([(i, centre[i].tolist(), size[i], at[i]) for i in sorted(centre)], f"{CENTROID} long, centroid array<double>, n long, at long")
        self._commit(version + 1, batch, lists, work)
        return True

    def _around(self, lists: set[int], centre: dict[int, np.ndarray]) -> set[int]:
        """The nearest lists of each."""
        numbers = sorted(centre)
        all_of = np.stack([centre[i] for i in numbers])
        return {numbers[j] for i in lists for j in np.argsort(((all_of - centre[i]) ** 2).sum(1), kind="stable")[: self.near + 1].tolist()}

    def _split(self, work: DataFrame, parts: dict[int, int], centre: dict[int, np.ndarray], affected: set[int], following: int) -> tuple[DataFrame, int]:
        """The lists' vectors in lists of their own; centre and affected follow."""
        own = cut(cut_lists(work, parts), "parts")
        means = own.select(CENTROID, "part", F.posexplode(VECTOR).alias("d", "x")).groupBy(CENTROID, "part", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
        means = means.groupBy(CENTROID, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("c"))
        names = []
        for i, part, c in sorted((r[0], r[1], r["c"]) for r in means.collect()):  # centroids
            name = i if part == 0 else following
            following += part != 0
            centre[name] = np.array(c)
            affected.add(name)
            names.append((i, part, name))
        named = F.broadcast(self.spark.createDataFrame(names, f"{CENTROID} long, part long, name long"))
        return own.join(named, [CENTROID, "part"]).select(ID, VECTOR, F.col("name").alias(CENTROID)), following

    def follow(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Apply each micro-batch of a stream of vec_id, embedding, deleted."""

        def batch(rows: DataFrame, number: int) -> None:
            self.apply(rows, number)

        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
