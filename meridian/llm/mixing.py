"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, once for each time
that a document may be taken, so a queue ends after that many rounds. Every
(document, round) has a virtual finish time: the number of its source's words
up to and with it, divided by the source's weight. Entries are queued in packets
of PACKET words, the packets of all sources are range-sorted by finish time, and
the mix is cut where the total budget, the sum of all targets in whole words, is
spent: partitions' totals first, then a running sum within the one partition
that the cut falls into. Around that packet the last words are sorted one by
one, so that every source ends at the same virtual time to a word. Where a
queue ends before the cut, the others go on: nothing of the cut is taken from
the targets but the budget. What is taken of a document is the sum over its
entries of what lies before its source's cut.

Cumulative words never need a source in one task: shuffle keys are uniform, so
(source, leading bits of the key) makes blocks of bounded expected size; words
are summed within blocks, and over the far smaller table of blocks. The driver
sees a row a partition and one packet; what is sorted by words is PACKET words
a source or so.

Nulls: a null text has size 0, a null source is a source of its own that sorts
last, documents without an id are shuffled by their text. Repeated rows share
their key and are ordered by size among themselves, so reruns agree; packets of
one finish time go by source. A very long text is many packets. Empty
tables give an empty mix. A source without words has target 0. Other columns,
whatever their names, come along only where keep names them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, cut

#: Hexadecimal digits of the shuffle key that name a block: 65,536 blocks a source.
BLOCK_DIGITS = 4
#: Most words of a packet.
PACKET = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, and sorts as sources do: by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(source_key, source_size, weight, target) from one row a source (source_key, source_size).

    Weights repeat over the sources in order. Targets are in proportion to them
    and add up to share times all sizes; none is above most times its source's
    size, and what that cuts off goes to the others by weight until none is
    above. That is water-filling: by ascending cap / weight, a source is capped
    if the level that it and the rest would reach is not below its own.
    The table has a row a source, not a row a document.
    """
    everything = Window.partitionBy()
    order = Window.orderBy("source_key")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("own", F.col("cap") / F.col("weight"))
    before = Window.orderBy("own", "rank").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    filled = ranked.withColumn("level", budget / free).withColumn("capped", F.col("own") <= F.col("level"))
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.struct("own", "rank"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("final"))
    return filled.withColumn("final", level).select("source_key", "source_size", "weight", target.alias("target"))


def fair_queue(docs: DataFrame, weights: list[int], share: float, most: float, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, times, finish for each row of docs, then the columns of keep, in order of finish.

    taken: words that the mix takes of it, repeats counted; times: how often it
    is begun; finish: its virtual finish time in its first round. ``most``
    bounds how often a source's queue is served, and so what is taken of a
    document, by that multiple of its size.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        source_key(F.col(source_column)).alias("source_key"),
        word_count(F.col(text_column)).alias("size"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary")))).cast("binary")).alias("key"),
        *([F.struct(*(c.alias(n) for n, c in keep.items())).alias("kept")] if keep else []),
    ).withColumn("block", F.substring("key", 1, BLOCK_DIGITS))
    words = cut(rows.groupBy("source_key", "block").agg(F.sum("size").alias("words")), "blocks")
    goal = cut(targets(words.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, share, most).withColumn("cap", F.floor(F.col("source_size") * F.lit(float(most))).cast("long")), "targets")
    upto = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = words.withColumn("before_block", F.coalesce(F.sum("words").over(upto), F.lit(0))).drop("words")
    rounds = math.ceil(most)
    packets = entered(queued(rows.drop("kept"), blocks.join(goal, "source_key")), rounds).where(F.col("words") > 0)
    ends = cut_sources(in_packets(packets), goal)
    entries = entered(queued(rows, blocks.join(goal.join(ends, "source_key"), "source_key")), rounds)
    taken = F.greatest(F.lit(0), F.least("words", F.col("end") - F.col("begin")))
    about = ["doc_id", "size", "source_size", "target", *(["kept"] if keep else [])]
    mixed = entries.withColumn("taken", taken).groupBy("source_key", "block", "place").agg(
        *(F.first(c).alias(c) for c in about),
        F.sum("taken").alias("taken"),
        F.sum((F.col("taken") > 0).cast("int")).cast("int").alias("times"),
        F.min((F.col("begin") + F.col("size")) / F.col("weight")).alias("finish"),
    )
    mixed = mixed.select(*about[:4], "taken", "times", "finish", *about[4:]).orderBy("finish", "doc_id")
    return mixed.select(*mixed.columns[:7], *(F.col("kept")[n].alias(n) for n in keep)) if keep else mixed


def queued(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with the columns of their block, their place in it and the words before them in it."""
    order = Window.partitionBy("source_key", "block").orderBy("key", "doc_id", "size")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(blocks, ["source_key", "block"])


def entered(queue: DataFrame, rounds: int) -> DataFrame:
    """The rows of queue once a round, with begin, the words before them in their source's queue, and words, those up to the queue's end.

    A document's entries stay in the task of its block.
    """
    entries = queue.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    entries = entries.withColumn("begin", F.col("round") * F.col("source_size") + F.col("before_block") + F.col("within"))
    return entries.withColumn("words", F.greatest(F.lit(0), F.least("size", F.col("cap") - F.col("begin"))))


def in_packets(entries: DataFrame) -> DataFrame:
    """source_key, begin, words, finish: entries in packets of at most PACKET words."""
    at = F.explode(F.sequence(F.lit(0), F.col("words") - 1, F.lit(PACKET)))
    packets = entries.select("source_key", "weight", "begin", "words", at.alias("at"))
    words = F.least(F.lit(PACKET), F.col("words") - F.col("at"))
    packets = packets.select("source_key", "weight", (F.col("begin") + F.col("at")).alias("begin"), words.cast("long").alias("words"))
    return packets.select("source_key", "begin", "words", ((F.col("begin") + F.col("words")) / F.col("weight")).alias("finish"))


def cut_sources(packets: DataFrame, goal: DataFrame) -> DataFrame:
    """(source_key, end): the words of each source's queue before the place where the budget is spent in the global order.

    goal: a row a source (source_key, weight, target, cap).
    """
    budget = goal.agg(F.sum(F.floor("target")).cast("long")).first()[0] or 0
    order = ["finish", "source_key", "begin"]
    dealt = packets.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()), "sorted")
    before, last = 0, None
    for part, words in sorted(dealt.groupBy("part").agg(F.sum("words")).collect()):
        if before + words >= budget:
            last = part
            break
        before += words
    if not budget or last is None:
        return goal.select("source_key", F.lit(0).cast("long").alias("end"))
    running = F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    spent = dealt.where(F.col("part") == last).withColumn("running", running).where(F.col("running") >= budget - before)
    finish = spent.agg(F.min("finish")).first()[0]
    return cut_words(goal, finish, budget)


def cut_words(goal: DataFrame, finish: float, budget: int) -> DataFrame:
    """(source_key, end): the first budget words of all queues in order of (position / weight, source_key), if they end by finish.

    Words up to finish are counted from the sources' weights; those too many are
    the last in that order, and less than a packet for each source that still
    has words then. Only words near enough to finish to be among them are sorted.
    """
    rate = F.col("weight").cast("double")
    near = F.floor(F.lit(finish) * rate).cast("long")
    reached = F.array_max(F.filter(F.array(near - 1, near, near + 1), lambda p: p / rate <= F.lit(finish)))
    ended = goal.withColumn("reached", F.least("cap", reached))
    total, sources, speed = ended.agg(F.sum("reached"), F.count("*"), F.sum(F.when(F.col("cap") / rate >= F.lit(finish), F.col("weight")))).first()
    extra = total - budget
    since = finish - (extra + sources) / speed
    low = F.greatest(F.lit(0).cast("long"), F.floor(F.lit(since) * rate).cast("long") - 1)
    words = ended.where(F.col("reached") > low).select("source_key", "weight", F.explode(F.sequence(low + 1, F.col("reached"))).alias("position"))
    over = words.orderBy((F.col("position") / rate).desc(), F.desc("source_key")).limit(extra).groupBy("source_key").agg(F.count("*").alias("over"))
    return ended.join(over, "source_key", "left").select("source_key", (F.col("reached") - F.coalesce("over", F.lit(0))).alias("end"))
