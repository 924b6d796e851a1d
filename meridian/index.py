"""The index API: build, load, search, add, delete."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import MeridianError
from .operators import graph as g
from .operators import walk as w
from .operators.cursor import IndexCursor
from .operators.knn import ID, QUERY, QUERY_VECTOR, VECTOR, knn, merge_top_k
from .shipping import ship
from .sources import files
from .sources.metadata import attach, write_metadata

EARLY_EXIT = ("none", "pruning")
DTYPES = ("float", "float32", "uint8", "int8")


def _positive(name: str, value: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise MeridianError(f"{name} must be a positive whole number")
    return value


class VectorIndex:
    """A graph index over a table of vectors, stored as Parquet beside a small description."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            self.meta = json.loads(files.read_range(f"{self.path}/meta.json", 0))
        except (OSError, ValueError) as e:
            raise MeridianError(f"no index at {path}: {e}") from e

    @classmethod
    def build(cls, vectors: DataFrame, path: str, degree: int = 16, refine: bool = False, metadata: str | None = None) -> VectorIndex:
        """Neighbour graph from leaves of several trees, with neighbours of neighbours if refined; vectors: vec_id, embedding, and text or bytes in a column metadata."""
        _positive("degree", degree)
        spark = vectors.sparkSession
        ship(spark)
        base = vectors.select(F.col(ID).cast("long").alias(ID), F.col(VECTOR).cast("array<float>").alias(VECTOR))
        dims = base.agg(F.min(F.size(VECTOR)), F.max(F.size(VECTOR))).first()
        if dims[0] is None:
            raise MeridianError("there are no vectors")
        if dims[0] != dims[1]:
            raise MeridianError("vectors of different dimensions")
        edges = g.leaf_edges(base, 2 * degree, dims[0])
        edges = g.nearer(edges, base, 2 * degree) if refine else edges
        with w.Graph(g.nodes(base, g.both_ways(edges, 2 * degree)), path=f"{path}/graph") as graph:
            meta = {"dims": dims[0], "degree": degree, "changes": 0, "buckets": graph.buckets, "entry": g.medoid(base), "metadata": []}
        if metadata is not None:
            write_metadata(vectors, f"{path}/metadata", metadata)
            meta["metadata"].append("metadata")
        files.write(f"{path}/meta.json", [json.dumps(meta).encode()])
        return cls(spark, path)

    load = classmethod(lambda cls, spark, path: cls(spark, path))

    def graph(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/graph")

    def _changes(self) -> DataFrame | None:
        """vec_id and embedding after the last change of each id; the embedding is null where that deletes."""
        here, parts = set(files.listing(self.path)), []
        for i in range(self.meta["changes"]):
            for kind in ("added", "deleted"):
                if f"{kind}-{i}" in here:
                    rows = self.spark.read.parquet(f"{self.path}/{kind}-{i}").withColumn("change", F.lit(i))
                    parts.append(rows if kind == "added" else rows.withColumn(VECTOR, F.lit(None).cast("array<float>")))
        if not parts:
            return None
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return every.groupBy(ID).agg(F.max_by(F.struct(VECTOR), "change").alias("last")).select(ID, f"last.{VECTOR}")

    def vectors(self) -> DataFrame:
        """vec_id and embedding of all that is in the index, changes included."""
        rows, changed = self.graph().select(ID, VECTOR), self._changes()
        if changed is None:
            return rows
        return rows.join(changed.select(ID), ID, "left_anti").unionByName(changed.where(F.col(VECTOR).isNotNull()))

    def _queries(self, queries: DataFrame | np.ndarray | Sequence) -> DataFrame:
        if not isinstance(queries, DataFrame):
            array = np.asarray(queries, np.float32)
            if array.ndim == 1:
                array = array[None]
            if array.ndim != 2 or not array.size:
                raise MeridianError("queries must be a matrix that isn't empty")
            if array.shape[1] != self.meta["dims"]:
                raise MeridianError(f"queries have {array.shape[1]} dimensions, the index {self.meta['dims']}")
            queries = self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(array)], f"{QUERY} long, {QUERY_VECTOR} array<float>")
        return queries

    def search(self, queries: DataFrame | np.ndarray | Sequence, topk: int = 10, *, ef_search: int = 50, early_exit_policy: str = "none", width: int = 8) -> DataFrame:
        """query_id, rank, vec_id, dist; width: nodes that a query expands in a round. A matrix of queries is numbered from 0; short results have fewer rows."""
        _positive("topk", topk), _positive("ef_search", ef_search), _positive("width", width)
        if early_exit_policy not in EARLY_EXIT:
            raise MeridianError(f"early_exit_policy must be one of {EARLY_EXIT}")
        asked = self._queries(queries)
        ship(self.spark)
        changed = self._changes()
        spare = topk + ef_search if changed is not None else topk
        rule = w.pruning() if early_exit_policy == "pruning" else None
        entry = self.spark.createDataFrame([(self.meta["entry"],)], f"{ID} long")
        with w.Graph.open(self.spark, f"{self.path}/graph", self.meta["buckets"]) as graph:
            found = w.walk(asked, graph, w.entry_of_all(asked, entry), spare, max(ef_search, spare), width, rule).results()
        if changed is None:
            return found
        ids = changed.select(ID)
        found = found.join(ids, ID, "left_anti")
        # queries around which more than ef_search vectors have changed are searched again, exactly
        enough = found.groupBy(QUERY).count().where(F.col("count") >= topk).select(QUERY)
        again = knn(asked.join(enough, QUERY, "left_anti"), self.graph().select(ID, VECTOR).join(ids, ID, "left_anti"), topk)
        parts = [found.join(enough, QUERY, "left_semi"), again, knn(asked, changed.where(F.col(VECTOR).isNotNull()), topk)]
        return merge_top_k(parts, topk)

    def with_metadata(self, rows: DataFrame) -> DataFrame:
        """rows and, as meta, the bytes last stored for their vec_id; null where there are none."""
        ship(self.spark)
        stores, names = self.meta.get("metadata", []), []
        for i, store in enumerate(reversed(stores)):
            names.append(f"_meta{i}")
            rows = attach(rows, f"{self.path}/{store}", ID, names[-1])
        meta = F.coalesce(*names) if names else F.lit(None).cast("binary")
        return rows.withColumn("meta", meta).drop(*names)

    def iterator(self, queries: DataFrame | np.ndarray | Sequence, path: str, ef_search: int = 50) -> IndexCursor:
        """A cursor in a new folder, whose next(k) gives the next k of each query; IndexCursor(spark, path, index) opens it again."""
        return IndexCursor.create(self._queries(queries), path, self, _positive("ef_search", ef_search))

    def search_arrays(self, queries: np.ndarray, topk: int = 10, **options) -> tuple[np.ndarray, np.ndarray]:
        """ids and distances as matrices; places not filled are -1 and infinite."""
        array = np.asarray(queries, np.float32)
        n = 1 if array.ndim == 1 else len(array)
        ids, distances = np.full((n, topk), -1, np.int64), np.full((n, topk), np.inf, np.float32)
        for r in self.search(array, topk, **options).toLocalIterator():
            ids[r[QUERY], r["rank"] - 1], distances[r[QUERY], r["rank"] - 1] = r[ID], r["dist"]
        return ids, distances

    def _change(self, kind: str, rows: DataFrame) -> None:
        n = self.meta["changes"]
        rows.write.parquet(f"{self.path}/{kind}-{n}")
        self.meta["changes"] = n + 1
        files.write(f"{self.path}/meta.json", [json.dumps(self.meta).encode()])

    def add(self, vectors: DataFrame, metadata: str | None = None) -> None:
        """Vectors that are searched exactly until the next build. Ids added again without metadata keep what they had."""
        if metadata is not None:
            name = f"metadata-{self.meta['changes']}"
            write_metadata(vectors, f"{self.path}/{name}", metadata)
            self.meta.setdefault("metadata", []).append(name)
        self._change("added", vectors.select(F.col(ID).cast("long").alias(ID), F.col(VECTOR).cast("array<float>").alias(VECTOR)))

    def delete(self, ids: DataFrame) -> None:
        self._change("deleted", ids.select(F.col(ID).cast("long").alias(ID)))
