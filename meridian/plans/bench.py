"""Benchmark analytics: points to fronts, curves and breakdowns.

A point is a row: system, dataset, ef, blocks, queries_per_block, pipe_width,
qps, recall and latencies. Which systems are shown under which name, and which
ef stands for which recall, are tables given by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.evaluate import best_under, keep_newest, pareto, scale_to_total

POINT_KEYS = ["system", "dataset", "ef", "queries_per_block", "pipe_width", "blocks"]


def named(points: DataFrame, names: dict[str, str]) -> DataFrame:
    """Systems under the names they are shown by."""
    out = F.col("system")
    for old, new in names.items():
        out = F.when(F.col("system") == old, F.lit(new)).otherwise(out)
    return points.withColumn("system", out)


def select(points: DataFrame, systems: list[str] | None = None, dataset: str | None = None, pipe_width: int | None = None, queries: list[int] | None = None) -> DataFrame:
    """Points that count: measured, without a variant, of the fixed settings; of all systems if none is named."""
    rows = points.where((F.col("qps") > 0) & (F.col("blocks") > 0))
    rows = rows if systems is None else rows.where(F.col("system").isin(*systems))
    if "variant" in points.columns:
        rows = rows.where(F.coalesce(F.col("variant"), F.lit("")) == "")
    if dataset is not None:
        rows = rows.where(F.col("dataset") == dataset)
    if pipe_width is not None:
        rows = rows.where(F.col("pipe_width") == pipe_width)
    return rows if queries is None else rows.where(F.col("queries_per_block").isin(*queries))


def join_tables(metrics: DataFrame, breakdown: DataFrame, samples: DataFrame) -> DataFrame:
    """Metrics with their breakdown as a map and the mean of their activity samples, by stem and variant."""
    keys = ["stem", "variant"]
    parts = breakdown.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", "avg_us"))).alias("breakdown"))
    means = samples.groupBy(*keys).agg(F.avg("cta_active_pct").alias("active_mean"), F.max("cta_active_pct").alias("active_max"))
    return metrics.join(parts, keys, "left").join(means, keys, "left")


def with_recall(points: DataFrame, table: list[tuple[str, int, float]]) -> DataFrame:
    """Adds target_recall from a table of (dataset, ef, recall)."""
    out = F.lit(None).cast("double")
    for dataset, ef, recall in table:
        out = F.when((F.col("dataset") == dataset) & (F.col("ef") == ef), F.lit(float(recall))).otherwise(out)
    return points.withColumn("target_recall", out)


def latency_fronts(points: DataFrame, keys: list[str], latency: str, cap: float | None = None) -> DataFrame:
    """Pareto fronts of throughput over latency, up to a cap if given."""
    rows = points if cap is None else points.where(F.col(latency) <= cap)
    return pareto(keep_newest(rows, [*POINT_KEYS], "seq") if "seq" in points.columns else rows, keys, latency, "qps")


def peak_by(points: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest throughput of each key; no latency cap."""
    return points.groupBy(*keys).agg(F.max("qps").alias("qps"))


def breakdown_stack(components: DataFrame, keys: list[str], total: str) -> DataFrame:
    """Components scaled to the total of their key."""
    return scale_to_total(components, keys, "avg_us", total)


def sensitivity(points: DataFrame) -> DataFrame:
    """qps and its gain over the smallest setting, by queries in flight (queries_per_block * pipe_width)."""
    rows = points.withColumn("q", F.col("queries_per_block") * F.col("pipe_width")).groupBy("system", "q").agg(F.max("qps").alias("qps"))
    return rows.withColumn("gain", F.col("qps") / F.first("qps").over(Window.partitionBy("system").orderBy("q")))


def utilisation(points: DataFrame, keys: list[str], active: str = "active_mean", pipe_width: int = 1) -> DataFrame:
    """keys, q and active: the greatest mean activity by queries in flight, of points of the pipe width; where a key has none at a q, of all its points there."""
    rows = points.where(F.col(active).isNotNull()).withColumn("q", F.col("queries_per_block") * F.col("pipe_width"))
    own = F.max(F.when(F.col("pipe_width") == pipe_width, F.col(active)))
    return rows.groupBy(*keys, "q").agg(F.coalesce(own, F.max(active)).alias(active))


def compared_fronts(ours: DataFrame, theirs: DataFrame, keys: list[str], latency: str, cap: float) -> DataFrame:
    """keys, side, qps and latency of two sides' fronts: ours up to a cap on latency, theirs without one.

    ours and theirs: keys, qps, latency; rows without a measurement (null, not a
    number, infinite, or of no throughput on our side) are no points.
    """
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    columns = [*keys, "qps", latency]
    left = ours.where(real("qps") & real(latency) & (F.col("qps") > 0) & (F.col(latency) <= cap)).select(*columns, F.lit("ours").alias("side"))
    right = theirs.where(real("qps") & real(latency)).select(*columns, F.lit("theirs").alias("side"))
    return pareto(left.unionByName(right), [*keys, "side"], latency, "qps").select(*columns, "side")


def hop_means(samples: DataFrame) -> DataFrame:
    """Mean wait and compute of each hop but the first."""
    return samples.where("hop > 0").groupBy("system", "hop").agg(F.avg("wait_us").alias("wait_us"), F.avg("compute_us").alias("compute_us"))


def verify(points: DataFrame, expected: DataFrame, keys: list[str], cap: float, tolerance: float) -> DataFrame:
    """Best throughput under the cap against stated values."""
    best = best_under(points, keys, "p99_ms", "qps", cap).select(*keys, F.col("qps").alias("measured"))
    return expected.join(best, keys, "left").withColumn("ok", F.coalesce(F.abs(F.col("measured") - F.col("stated")) <= tolerance, F.lit(False)))
