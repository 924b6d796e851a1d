"""How many lists a search has to probe: recall and rows scanned at every number of probes, from one pass."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ivf import CENTROID
from .kmeans import _sums
from .knn import ID, QUERY, VECTOR
from .rank import ranked


def even_centroids(vectors: DataFrame, count: int | None = None, rounds: int = 1) -> DataFrame:
    """centroid_id, centroid: count rows at even steps of the order of ids, moved to the mean of their lists in each round.

    Without a count there are as many as the square root of the rows, so that
    lists and centroids grow alike. All rows count in the means, of which a row
    a task and centroid is shuffled. A list that no row is nearest to keeps its
    centroid. An empty table has none. Centroids pass the driver: 100 MB for 10^10
    rows of 128 dimensions.
    """
    rows = ranked(vectors.select(ID, F.col(VECTOR).cast("array<double>").alias(VECTOR)), ID, rank="place")
    n = rows.count()
    count = min(n, count or math.isqrt(n))
    if not count:
        return rows.select(F.col("place").alias(CENTROID), F.col(VECTOR).alias("centroid"))
    step = n // count
    picked = rows.where((F.col("place") % step == 0) & (F.col("place") < step * count)).orderBy("place").toArrow()
    centres = np.array(picked[VECTOR].to_pylist())
    for _ in range(rounds):
        sums, counts = _sums(rows, centres, np.zeros(count))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], f"{CENTROID} long, centroid array<double>")


def curve(probes: DataFrame, lists: DataFrame, truth: DataFrame) -> DataFrame:
    """nprobe, recall, error, scanned: what a search of that many lists finds of the truth, and the share of all rows that it scans.

    probes: query_id, rank, centroid_id, as deep as the curve is to go; truth:
    query_id, vec_id. A neighbour is found from the rank of the first probed
    list that it is in, so no search is run. recall is the mean over queries,
    error its standard error (0 for one query). Queries without any truth don't
    count in recall.
    """
    sizes = lists.groupBy(CENTROID).agg(F.count("*").alias("n"))
    first = truth.select(QUERY, ID).join(lists.select(ID, CENTROID), ID).join(probes.select(QUERY, CENTROID, "rank"), [QUERY, CENTROID]).groupBy(QUERY, ID).agg(F.min("rank").alias("rank"))
    found = first.groupBy(QUERY, "rank").agg(F.count("*").alias("found"))
    wanted = truth.groupBy(QUERY).agg(F.count("*").alias("wanted"))
    upto = Window.partitionBy(QUERY).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # a row a probe
    each = probes.select(QUERY, "rank", CENTROID).join(sizes, CENTROID, "left").join(found, [QUERY, "rank"], "left").join(wanted, QUERY, "left")
    each = each.select("rank", (F.sum(F.coalesce("found", F.lit(0))).over(upto) / F.col("wanted")).alias("r"), F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("rows"))
    error = F.coalesce(F.stddev_samp("r") / F.sqrt(F.count("r")), F.lit(0.0))
    steps = each.groupBy(F.col("rank").alias("nprobe")).agg(F.avg("r").alias("recall"), error.alias("error"), F.avg("rows").alias("rows"))
    return steps.join(sizes.agg(F.sum("n").alias("all"))).select("nprobe", "recall", "error", (F.col("rows") / F.col("all")).alias("scanned"))


def fewest(steps: DataFrame, recall: float, sure: float = 1.645) -> int:
    """The least nprobe whose recall less so many standard errors reaches the aim (1.645: for other queries of the kind, 19 times in 20), or the last.

    The curve of few queries is uncertain, and the least number that reaches an
    aim on them is more often too small than too large for others.
    """
    enough = F.col("recall") - sure * F.col("error") >= recall
    row = steps.agg(F.min(F.when(enough, F.col("nprobe"))), F.max("nprobe")).first()
    return row[0] or row[1] or 1
