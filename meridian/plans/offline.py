"""An offline job over lists: train, shard, search, check; each stage is a table, and a stage that was done isn't done again.

The manifest says which tables are whole, from which parameters and which
vectors. A job that was killed goes on with the first stage, or the first batch
of queries, that isn't there; other parameters or other vectors start anew from
where they count.

Lists are cut into slices of bounded length, and the queries that probe a list
into blocks, so a list that a third of the vectors is in, or that a third of the
queries probes, is many tasks. A task takes one block against one slice and
keeps k a query. Centroids are sent to executors and may have 256 MB. Vectors
that are null are in no list.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MeridianError
from ..functions.vectors import as_double, squared_l2
from ..operators.kmeans import assign_step, kmeans
from ..operators.knn import ID, QUERY, QUERY_VECTOR, VECTOR, _matrix, _nearest, as_queries, top_k
from ..operators.rank import ranked
from ..shipping import ship
from ..sources import files

CENTRE_BYTES = 256 << 20
LIST = "list_id"


class OfflineJob:
    """vectors: vec_id, embedding; queries: query_id, q, all vectors if none are given (self-search)."""

    def __init__(self, vectors: DataFrame, path: str, lists: int, nprobe: int, k: int = 50, queries: DataFrame | None = None, iterations: int = 5, slice_rows: int = 1 << 16, block_rows: int = 1 << 14, query_rows: int = 50_000_000):
        if min(lists, nprobe, k, slice_rows, block_rows, query_rows) < 1:
            raise MeridianError("lists, probes, results and sizes must be positive")
        self.spark, self.path = vectors.sparkSession, path.rstrip("/")
        ship(self.spark)
        self.own = queries is None
        self.vectors = vectors.select(F.col(ID).cast("long").alias(ID), F.col(VECTOR).cast("array<float>").alias(VECTOR)).where(F.col(VECTOR).isNotNull())
        self.queries = (as_queries(self.vectors) if queries is None else queries.select(QUERY, QUERY_VECTOR)).where(F.col(QUERY_VECTOR).isNotNull())
        self.lists, self.nprobe, self.k, self.iterations = lists, nprobe, k, iterations
        self.slice_rows, self.block_rows, self.query_rows = slice_rows, block_rows, query_rows
        self.made: list[str] = []
        store, inner = files.resolve(self.path)
        store.create_dir(inner, recursive=True)

    # -- the manifest

    def manifest(self) -> dict[str, dict]:
        """stage: its table and the sum of what it was made from; of manifests that were broken off the one before counts."""
        for name in sorted((n for n in files.listing(self.path) if n.startswith("manifest-")), reverse=True):
            try:
                return json.loads(files.read_range(f"{self.path}/{name}", 0))
            except ValueError:
                continue
        return {}

    def _stage(self, name: str, made_from: str, make: Callable[[], DataFrame]) -> DataFrame:
        known = self.manifest()
        if known.get(name, {}).get("from") != made_from:
            table = f"{name}-{uuid.uuid4().hex}"
            make().write.parquet(f"{self.path}/{table}")
            known[name] = {"from": made_from, "table": table}
            done = sum(n.startswith("manifest-") for n in files.listing(self.path))
            files.write(f"{self.path}/manifest-{done:06d}.json", [json.dumps(known).encode()])
            self.made.append(name)
        return self.spark.read.parquet(f"{self.path}/{known[name]['table']}")

    @staticmethod
    def _sum(*parts) -> str:
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()

    def _content(self, rows: DataFrame) -> str:
        """What tells tables apart: their rows and the sum of their hashes."""
        n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
        return f"{n}:{total}"

    # -- the stages

    def train(self) -> tuple[DataFrame, str]:
        """list_id, centroid: k-means over all vectors."""
        made_from = self._sum("train", self._content(self.vectors), self.lists, self.iterations)

        def make() -> DataFrame:
            centres = kmeans(self.vectors, self.lists, self.iterations)
            if centres.nbytes > CENTRE_BYTES:
                raise MeridianError(f"centroids of {centres.nbytes} bytes can't be sent to executors")
            return self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], f"{LIST} long, centroid array<double>")

        return self._stage("train", made_from, make), made_from

    def _centres(self, trained: DataFrame) -> np.ndarray:
        rows = trained.orderBy(LIST).toArrow()  # CENTRE_BYTES at most
        return _matrix(rows["centroid"].combine_chunks())

    def shard(self) -> tuple[DataFrame, str]:
        """list_id, slice, vec_id, embedding: slices of consecutive ids of a list, slice_rows each at most."""
        trained, before = self.train()
        made_from = self._sum("shard", before, self.slice_rows)

        def make() -> DataFrame:
            centres = self._centres(trained)
            near = assign_step(self.vectors, centres, np.zeros(len(centres))).select(ID, F.col("centroid_id").alias(LIST))
            rows = ranked(near.join(self.vectors, ID), LIST, ID)
            return rows.select(LIST, F.floor(F.col("rank") / self.slice_rows).cast("long").alias("slice"), ID, VECTOR)

        return self._stage("shard", made_from, make), made_from

    def search(self) -> tuple[DataFrame, str]:
        """query_id, rank, vec_id, dist: the k nearest in the nprobe lists nearest to each query, a batch of queries at a time."""
        sharded, before = self.shard()
        asked = "own" if self.own else self._content(self.queries)
        batches = max(1, -(-self.queries.count() // self.query_rows))
        made_from = self._sum("search", before, asked, self.nprobe, self.k, batches)
        out = None
        for i in range(batches):
            part = self.queries.where(F.pmod(F.xxhash64(QUERY), F.lit(batches)) == i)
            found = self._stage(f"search-{i}", self._sum(made_from, i), lambda part=part: self._found(part, sharded))
            out = found if out is None else out.unionByName(found)
        return out, made_from

    def _probes(self, queries: DataFrame) -> DataFrame:
        """query_id, q, list_id of the nprobe nearest lists."""
        held, most = self.spark.sparkContext.broadcast(self._centres(self.train()[0])), self.nprobe

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    x = _matrix(part.column(1))
                    d = (centres * centres).sum(1)[None] - 2 * x @ centres.T
                    near = np.argsort(d, axis=1, kind="stable")[:, :most]
                    row = np.repeat(np.arange(len(x)), near.shape[1])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(near.reshape(-1))], [QUERY, QUERY_VECTOR, LIST])

        return queries.select(F.col(QUERY).cast("long").alias(QUERY), as_double(F.col(QUERY_VECTOR)).alias(QUERY_VECTOR)).mapInArrow(run, f"{QUERY} long, {QUERY_VECTOR} array<double>, {LIST} long")

    def _found(self, queries: DataFrame, sharded: DataFrame) -> DataFrame:
        probes, k = self._probes(queries), self.k
        # how many blocks a list's queries make
        asked = probes.groupBy(LIST).agg(F.ceil(F.count("*") / self.block_rows).cast("int").alias("blocks"))
        slices = sharded.select(LIST, "slice").distinct().join(asked, LIST)
        block = F.pmod(F.xxhash64(QUERY), F.col("blocks")).cast("int")
        left = probes.join(slices, LIST).select(LIST, "slice", block.alias("block"), QUERY, QUERY_VECTOR).toDF("l", "s", "b", QUERY, QUERY_VECTOR)
        right = sharded.join(asked, LIST).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(LIST, "slice", "block", ID, as_double(F.col(VECTOR)).alias(VECTOR))

        def meet(asked: pa.Table, own: pa.Table) -> pa.Table:
            numbers, out = asked[QUERY].to_numpy(), []
            if len(numbers) and own.num_rows:
                q, x, ids = _matrix(asked[QUERY_VECTOR].combine_chunks()), _matrix(own[VECTOR].combine_chunks()), own[ID].to_numpy()
                for at in range(0, len(q), 256):
                    row, found, value = _nearest(q[at : at + 256], ids, x, k, "l2")
                    out.append(pa.table({QUERY: numbers[at : at + 256][row], ID: found, "dist": value}))
            return pa.concat_tables(out) if out else pa.table({QUERY: pa.array([], pa.int64()), ID: pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})

        found = left.groupBy("l", "s", "b").cogroup(right.groupBy(LIST, "slice", "block")).applyInArrow(meet, f"{QUERY} long, {ID} long, dist double")
        return top_k(found, k).select(QUERY, "rank", ID, "dist")

    def check(self) -> DataFrame:
        """check, rows, bad: what was looked at and how much of it is wrong.

        lists: vectors that aren't in exactly one list; slices: slices that are
        too long; ranks: queries whose results repeat an id, leave out a rank or
        aren't in order; distances: results whose distance isn't that of their
        vectors; self (of a self-search): queries whose first result is farther
        than 0, where they are themselves.
        """
        found, before = self.search()
        sharded = self.shard()[0]

        def counted(name: str, rows: DataFrame, bad) -> DataFrame:
            return rows.agg(F.lit(name).alias("check"), F.count("*").alias("rows"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).cast("long").alias("bad"))

        def make() -> DataFrame:
            times = self.vectors.select(ID).join(sharded.groupBy(ID).count(), ID, "full")
            lengths = sharded.groupBy(LIST, "slice").count()
            a_query = found.groupBy(QUERY).agg(F.array_sort(F.collect_list(F.struct("rank", "dist", ID))).alias("r"))  # k at most
            r = F.col("r")
            sound = (F.size(F.array_distinct(r[ID])) == F.size("r")) & (r["rank"] == F.sequence(F.lit(1), F.size("r")).cast("array<long>")) & (r["dist"] == F.array_sort(r["dist"]))
            exact = found.join(self.vectors, ID, "left").join(self.queries, QUERY, "left").select("dist", squared_l2(F.col(QUERY_VECTOR), F.col(VECTOR)).alias("own"))
            parts = [
                counted("lists", times, ~F.coalesce(F.col("count") == 1, F.lit(False))),
                counted("slices", lengths, F.col("count") > self.slice_rows),
                counted("ranks", self.queries.select(QUERY).join(a_query, QUERY, "left"), ~F.coalesce(sound, F.lit(False))),
                counted("distances", exact, ~F.coalesce(F.abs(F.col("dist") - F.col("own")) <= 1e-6 * (1 + F.col("own")), F.lit(False))),
            ]
            if self.own:
                parts.append(counted("self", self.vectors.select(F.col(ID).alias(QUERY)).join(found.where("rank = 1"), QUERY, "left"), ~F.coalesce(F.col("dist") == 0, F.lit(False))))
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            return out

        return self._stage("check", self._sum("check", before), make)

    run = check
