"""Recall, traces, intervals and other evaluation of search results, as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percentile_rank, required_hits
from .knn import ID, QUERY


def hits(results: DataFrame, truth: DataFrame, k: int | None) -> DataFrame:
    """Result rows that are in the ground truth; k: only its first k ranks count, None: all of it."""
    wanted = truth if k is None else truth.where(F.col("rank") <= k)
    mine = results if k is None else results.where(F.col("rank") <= k)
    return mine.join(wanted.select(QUERY, ID).distinct(), [QUERY, ID], "left_semi")


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: recall, hits over k for each query of the ground truth."""
    found = hits(results, truth, k).agg(F.count("*").alias("hits"))
    asked = truth.agg(F.countDistinct(QUERY).alias("queries"))
    return found.join(asked).select("hits", "queries", (F.col("hits") / (F.col("queries") * F.lit(k))).alias("recall"))


def recall_by_query(results: DataFrame, truth: DataFrame, k: int, n_truth: int | None = None) -> DataFrame:
    """query_id, gt_query_id, hits, recall. Queries past n_truth repeat the ground truth from its start."""
    own = F.pmod(F.col(QUERY), F.lit(n_truth)) if n_truth else F.col(QUERY)
    asked = results.where(F.col("rank") <= k).select(F.col(QUERY).alias("asked"), ID, own.alias(QUERY))
    wanted = truth.where(F.col("rank") <= k).select(QUERY, ID, F.lit(1).alias("hit"))
    met = asked.join(wanted, [QUERY, ID], "left")
    sums = met.groupBy("asked", QUERY).agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"))
    return sums.select(F.col("asked").alias("query_id"), F.col(QUERY).alias("gt_query_id"), "hits", (F.col("hits") / F.lit(k)).alias("recall"))


def step_recall(trace: DataFrame, truth: DataFrame, k: int, threshold: float) -> DataFrame:
    """query_id, step, hits, recall, reached. trace: query_id, step, vec_id, an id being found at a step; hits count against the whole truth."""
    met = trace.join(truth.select(QUERY, ID, F.lit(1).alias("hit")), [QUERY, ID], "left")
    steps = met.groupBy(QUERY, "step").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("new"))
    so_far = Window.partitionBy(QUERY).orderBy("step")
    steps = steps.withColumn("hits", F.sum("new").over(so_far)).drop("new")
    need = required_hits(F.lit(threshold), F.lit(k))
    return steps.select(QUERY, "step", "hits", (F.col("hits") / F.lit(k)).alias("recall"), (F.col("hits") >= need).alias("reached"))


def first_reached(steps: DataFrame) -> DataFrame:
    """query_id, step: where each query first reached the threshold, -1 if nowhere."""
    return steps.groupBy(QUERY).agg(F.coalesce(F.min(F.when(F.col("reached"), F.col("step"))), F.lit(-1)).cast("long").alias("step"))


def step_report(first: DataFrame) -> DataFrame:
    """One row: reached, unreached, and avg, p50, p90, p99, max of the steps of those that did."""
    done = F.col("step") >= 0
    counted = first.groupBy("step").agg(F.count("*").alias("c"))  # steps are few, whatever the number of queries
    order = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.where("step >= 0").withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    picks = [F.min(F.when(F.col("upto") >= percentile_rank(F.col("n"), p), F.col("step"))).alias(f"p{p:.0f}") for p in (50.0, 90.0, 99.0)]
    stats = ranked.agg((F.sum(F.col("step") * F.col("c")) / F.sum("c")).alias("avg"), *picks, F.max("step").alias("max"))
    sums = first.agg(F.coalesce(F.sum(done.cast("long")), F.lit(0)).alias("reached"), F.coalesce(F.sum((~done).cast("long")), F.lit(0)).alias("unreached"))
    return sums.join(stats)


def step_average(rows: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Mean of steps that were taken; negative ones weren't."""
    return rows.groupBy(*keys).agg(F.avg(F.when(F.col(step) >= 0, F.col(step))).alias("avg_step"), F.count(F.when(F.col(step) >= 0, 1)).alias("finished"))


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """keys, start, end of the union of intervals; empty and reversed ones don't count."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.where(F.col(end) > F.col(start))
    rows = rows.withColumn("reach", F.max(end).over(before))
    rows = rows.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col(start) > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def union_length(rows: DataFrame, keys: list[str], start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    return merge_intervals(rows, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("busy"))


def completed_latency(rows: DataFrame, submit: str, complete: str) -> DataFrame:
    """latency_us of requests that completed, that is, not before they were submitted."""
    return rows.where((F.col(complete) > 0) & (F.col(complete) >= F.col(submit))).withColumn("latency_us", (F.col(complete) - F.col(submit)) / F.lit(1000.0))


def block_timeline(start: Column, done: Column, idle: Column) -> tuple[Column, Column, Column, Column]:
    """total, idle, active in microseconds and idle percent of a block from nanoseconds."""
    total = (done - start) / F.lit(1000.0)
    rest = idle / F.lit(1000.0)
    return total, rest, total - rest, F.when(total > 0, rest * 100.0 / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0))


def scale_to_total(rows: DataFrame, keys: list[str], component: str, target: str) -> DataFrame:
    """Adds scaled: components in proportion, adding up to the target; 0 where they don't add up to anything."""
    whole = F.sum(component).over(Window.partitionBy(*keys))
    return rows.withColumn("scaled", F.when(whole > 0, F.col(target) * F.col(component) / F.nullif(whole, F.lit(0.0))).otherwise(F.lit(0.0)))


def cdf_points(rows: DataFrame, keys: list[str], value: str, points: int = 200) -> DataFrame:
    """keys, point, x, p: the value at rank point * n / points (whole number) and (rank + 1) / n.

    Equal values are counted before ranking, so a key's window holds distinct values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    counted = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("x"))).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    # points whose rank lies in [upto - c, upto)
    low = F.ceil((F.col("upto") - F.col("c")) * points / F.col("n"))
    high = F.ceil(F.col("upto") * points / F.col("n")) - 1
    spread = counted.where(low <= high).withColumn("point", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    rank = F.floor(F.col("point") * F.col("n") / points)
    return spread.select(*keys, "point", "x", ((rank + 1) / F.col("n")).alias("p"))


def pareto(rows: DataFrame, keys: list[str], latency: str, qps: str) -> DataFrame:
    """Rows with more throughput than all of lower latency; rows without numbers don't count."""
    good = rows.where(F.col(latency).isNotNull() & F.col(qps).isNotNull() & ~F.isnan(F.col(latency).cast("double")) & ~F.isnan(F.col(qps).cast("double")))
    order = Window.partitionBy(*keys).orderBy(F.col(latency), F.desc(qps)).rowsBetween(Window.unboundedPreceding, -1)
    good = good.withColumn("best", F.max(qps).over(order))
    return good.where(F.col("best").isNull() | (F.col(qps) > F.col("best"))).drop("best")


def best_under(rows: DataFrame, keys: list[str], latency: str, qps: str, cap: float) -> DataFrame:
    """The row of most throughput below the latency cap; where none is, that of least latency."""
    good = rows.where(~F.isnan(F.col(latency).cast("double")) & ~F.isnan(F.col(qps).cast("double")))
    under = F.col(latency) < cap
    order = Window.partitionBy(*keys).orderBy(under.desc(), F.when(under, -F.col(qps)), F.col(latency), F.desc(qps))
    return good.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def keep_newest(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last occurrence of each key, found by a partial aggregate."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, F.col(sequence)).alias("r")).select("r.*")


def drop_adjacent_repeats(rows: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(value))).drop("before")


def streaks(rows: DataFrame, keys: list[str], order: str, improved: Column) -> DataFrame:
    """Adds no_improve: rows since the last one that improved."""
    along = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("ok", improved.cast("int")).withColumn("run", F.sum("ok").over(along))
    return rows.withColumn("no_improve", F.sum(1 - F.col("ok")).over(Window.partitionBy(*keys, "run").orderBy(order))).drop("ok", "run")


def prune_trace(trace: DataFrame, warm_up: int = 10, patience: int = 8, keys: tuple[str, ...] = (QUERY,)) -> DataFrame:
    """The keys of a walk, and the step where a search may stop: after warm_up steps, patience of them without improvement.

    trace: query_id, step, found, top1, topk. A step improves if more was found
    or a distance shrank.
    """
    along = Window.partitionBy(*keys).orderBy("step")
    better = (F.col("found") > F.lag("found").over(along)) | (F.col("top1") < F.lag("top1").over(along)) | (F.col("topk") < F.lag("topk").over(along))
    marked = trace.withColumn("better", F.coalesce(better, F.lit(True)))
    run = streaks(marked, [*keys], "step", F.col("better"))
    stop = (F.col("step") >= warm_up) & (F.col("no_improve") >= patience)
    return run.groupBy(*keys).agg(F.coalesce(F.min(F.when(stop, F.col("step"))), F.lit(-1)).cast("long").alias("stop_step"))


def sticky(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds name: the last value that isn't null, up to each row."""
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, True).over(along))


def batch_completion(rows: DataFrame, keys: list[str], order: str, size: int, start: str, end: str) -> DataFrame:
    """keys, batch, start, done: batches of size rows by order of start; each is done when its last row is."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(start, order)) - 1
    rows = rows.withColumn("batch", F.floor(place / size).cast("long"))
    return rows.groupBy(*keys, "batch").agg(F.min(start).alias("start"), F.max(end).alias("done"), F.count("*").alias("n"))


def latest(rows: DataFrame, keys: list[str], *stamp: str) -> DataFrame:
    """The row of the largest stamp of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*stamp)).alias("r")).select("r.*")


def counters(rows: DataFrame, keys: list[str], **states: Column) -> DataFrame:
    """How many rows of each key are in each state."""
    return rows.groupBy(*keys).agg(*(F.sum(F.coalesce(c.cast("long"), F.lit(0))).alias(name) for name, c in states.items()))
