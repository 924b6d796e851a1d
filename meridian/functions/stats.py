"""Rank percentiles, recall thresholds and rates as the evaluation layer defines them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = {"p50": 50.0, "p90": 90.0, "p99": 99.0, "p999": 99.9}
PAGE_BYTES = 4096


def percentile_rank(n: Column, p: float) -> Column:
    """1-based rank of a percentile: floor(n * p / 100) + 1, at most n. There is no interpolation."""
    return F.least(F.floor(n * F.lit(p) / F.lit(100.0)).cast("long") + 1, n)


def latency_summary(rows: DataFrame, keys: list[str], value: str, percentiles: dict[str, float] = PERCENTILES) -> DataFrame:
    """count, avg, percentiles and max of a value, by keys.

    Values are counted before they are ranked, so that a hot key's window holds
    distinct values with their numbers, not rows; ranks come from running sums.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    along = Window.partitionBy(*keys).orderBy("x")
    whole = Window.partitionBy(*keys)
    ranked = counted.withColumn("upto", F.sum("c").over(along)).withColumn("n", F.sum("c").over(whole))
    picks = [F.min(F.when(F.col("upto") >= percentile_rank(F.col("n"), p), F.col("x"))).alias(name) for name, p in percentiles.items()]
    return ranked.groupBy(*keys).agg(F.max("n").alias("count"), (F.sum(F.col("x") * F.col("c")) / F.max("n")).alias("avg"), *picks, F.max("x").alias("max"))


def required_hits(threshold: Column, k: Column) -> Column:
    """Hits that a recall threshold asks for: at least 1, at most k."""
    return F.greatest(F.lit(1), F.least(k, F.ceil(threshold * k - F.lit(1e-6)).cast("int"))).cast("int")


def rate(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds)


def iops(pages: Column, seconds: Column) -> Column:
    """Rounded half up."""
    return F.floor(rate(pages, seconds) + F.lit(0.5)).cast("long")


def bandwidth_gib(pages: Column, seconds: Column) -> Column:
    return rate(pages * F.lit(PAGE_BYTES), seconds) / F.lit(float(1 << 30))


def activity_percent(active: Column, window: Column) -> Column:
    return F.when(window > 0, F.least(F.lit(100.0), active * F.lit(100.0) / F.nullif(window, F.lit(0)))).otherwise(F.lit(0.0))
