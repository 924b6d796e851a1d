"""Streams of queries against an index, streams of changes to it, and windows of latencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ivf import build
from ..operators.knn import ID, QUERY, knn


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Search each micro-batch of a stream of queries and append results as Parquet.

    Admission is the source's rate limit (maxFilesPerTrigger and the like). The
    batch's number is written beside its rows, and a batch that is repeated
    after a failure replaces its own folder, so results are there once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        search(rows).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def exact_search(vectors: DataFrame, k: int) -> Callable[[DataFrame], DataFrame]:
    return lambda queries: knn(queries, vectors, k)


def update_stream(changes: DataFrame, centroids: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep an index's lists up to date: a stream of vec_id, embedding, deleted is assigned to lists and appended.

    Of several changes of an id the one of the latest batch counts; lists are
    read back by current_lists.
    """

    def batch(rows: DataFrame, number: int) -> None:
        fresh = rows.where(~F.col("deleted")).select(ID, "embedding")
        lists = build(fresh, centroids).select("centroid_id", ID, "embedding", F.lit(False).alias("deleted"))
        gone = rows.where("deleted").select(F.lit(None).cast("long").alias("centroid_id"), ID, F.lit(None).cast("array<float>").alias("embedding"), F.lit(True).alias("deleted"))
        lists.withColumn("embedding", F.col("embedding").cast("array<float>")).unionByName(gone).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_lists(changes: DataFrame) -> DataFrame:
    """Lists after all changes: the latest of each id, without those deleted."""
    last = changes.groupBy(ID).agg(F.max_by(F.struct("centroid_id", "embedding", "deleted"), F.struct("batch", "deleted")).alias("x"))
    return last.where(~F.col("x.deleted")).select("x.centroid_id", ID, "x.embedding")


def rebalance(lists: DataFrame, least: int, most: int) -> DataFrame:
    """centroid_id, n, action: lists to merge, to split, or to keep."""
    sizes = lists.groupBy("centroid_id").agg(F.count("*").alias("n"))
    return sizes.withColumn("action", F.when(F.col("n") < least, "merge").when(F.col("n") > most, "split").otherwise("keep"))


def latency_windows(events: DataFrame, width: str, late: str, time: str = "ts", value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, largest and an approximate p99 of a value in tumbling windows; events later than ``late`` are dropped from a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.percentile_approx(value, 0.99, 10_000).alias("p99"))
    return grouped.select(F.col("window.start").alias("start"), *keys, "n", "avg", "max", "p99")


__all__ = ["QUERY", "current_lists", "exact_search", "latency_windows", "rebalance", "search_stream", "update_stream"]
