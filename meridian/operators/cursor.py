"""Cursors: the next nearest of each query, a page at a time, without repeating any.

A cursor is a folder: the queries, the pages given so far, a line of JSON a page
once it is whole. It can be opened again where it was left; a page that was
broken off is made anew, with the same rows if the vectors are the same.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MeridianError
from ..sources import files
from .knn import ID, QUERY, QUERY_VECTOR, knn, top_k


class Cursor:
    """Pages of an exact search, each of vectors beyond the (dist, vec_id) of its query's last: what was given isn't searched or kept in mind again."""

    def __init__(self, spark: SparkSession, path: str, vectors: DataFrame | None = None):
        self.spark, self.path, self.vectors = spark, path.rstrip("/"), vectors
        if "state.json" not in (files.listing(self.path) if files.exists(self.path) else ()):
            raise MeridianError(f"no cursor at {path}")

    @classmethod
    def create(cls, queries: DataFrame, path: str, *args, **options) -> Cursor:
        """queries: query_id, q, a stated set; each id once."""
        queries.select(QUERY, F.col(QUERY_VECTOR).cast("array<float>").alias(QUERY_VECTOR)).write.parquet(f"{path}/queries")
        files.write(f"{path}/state.json", [json.dumps([]).encode()])
        return cls(queries.sparkSession, path, *args, **options)

    def pages(self) -> list[int]:
        """The sizes that were asked for, a page each."""
        return json.loads(files.read_range(f"{self.path}/state.json", 0))

    def queries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/queries")

    def given(self) -> DataFrame | None:
        """page, query_id, rank, vec_id, dist of all pages; None before the first."""
        n = len(self.pages())
        if not n:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/page-{i}").withColumn("page", F.lit(i + 1)) for i in range(n)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.select("page", QUERY, "rank", ID, "dist")

    def next(self, k: int) -> DataFrame:
        """The next k of each query, ranks counted on; fewer or none where there are no more."""
        if not isinstance(k, int) or isinstance(k, bool) or k < 1:
            raise MeridianError("a page must have a positive whole number of rows")
        done = self.pages()
        target = f"{self.path}/page-{len(done)}"
        self._more(k, done).select(QUERY, (F.col("rank") + sum(done)).alias("rank"), ID, "dist").write.mode("overwrite").parquet(target)
        files.write(f"{self.path}/state.json", [json.dumps([*done, k]).encode()])
        return self.spark.read.parquet(target)

    def _more(self, k: int, done: list[int]) -> DataFrame:
        asked, given = self.queries(), self.given()
        if given is not None:
            asked = asked.join(given.groupBy(QUERY).agg(F.max(F.struct("dist", ID)).alias("last")), QUERY, "left")
        return knn(asked, self.vectors, k)


class IndexCursor(Cursor):
    """Pages of a graph index: each search goes deeper, with a beam of twice what was and will be given, and leaves out what was given."""

    def __init__(self, spark: SparkSession, path: str, index, ef_search: int = 50):
        super().__init__(spark, path)
        self.index, self.ef = index, ef_search

    def _more(self, k: int, done: list[int]) -> DataFrame:
        depth, given = sum(done) + k, self.given()
        found = self.index.search(self.queries(), depth, ef_search=max(self.ef, 2 * depth))
        if given is not None:
            found = found.join(given.select(QUERY, ID), [QUERY, ID], "left_anti")
        return top_k(found.select(QUERY, ID, "dist"), k)
