"""Connected components by alternating stars (distributed union-find), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._shared import cut, drop_cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, or to the node."""
    ways = _both_ways(edges)
    least = ways.groupBy("a").agg(F.min("b").alias("m"))
    linked = ways.where("b > a").join(least, "a")
    return linked.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and checksum, which the job that writes them gathers."""
    seen = Observation()
    now = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
    return now, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b): the smallest node of its component. Roots have a row too.

    A round halves what isn't a star yet; a node with very many neighbours is
    pre-aggregated and its joins are splittable. Each round is written to the
    shared folder, and nothing but a count and a checksum reaches the driver.
    """
    now, before = _observed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if not before[0]:
            break
        then, after = _observed(_small_star(_large_star(now)))
        drop_cut(now)
        now = then
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't converge in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
