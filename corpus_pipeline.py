"""Training-corpus pipeline over ``documents``: each stage is an operator of meridian.llm.

Toxic texts go; repeated lines go; of near-duplicates one stays; texts that hold
benchmark items go; what is left is mixed to the sources' target weights. Each
stage takes what its predecessor kept and returns the columns of documents; the
last adds how much of each document the mix takes, in the order of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm._shared import cut, table
from meridian.llm.decontaminate import clean
from meridian.llm.linededup import line_dedup
from meridian.llm.mixing import fair_queue
from meridian.llm.neardup import one_of_each
from meridian.llm.registry import MOST, SHARE, WEIGHTS
from meridian.llm.toxicity import fit, held_out, score
from meridian.shipping import ship

TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC."""
    ship(spark)
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out("id"))
    names = docs.columns
    return score(docs, model).where(F.col("score") < TOXIC).select(*(F.col("row")[c].alias(c) for c in names))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that another document, or the same one before, has."""
    ship(spark)
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    ship(spark)
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, in its order, with their size, words taken and number of rounds."""
    ship(spark)
    names = docs.columns
    mixed = fair_queue(docs, WEIGHTS, SHARE, MOST, keep={"row": F.struct(*(docs[c] for c in names))})
    added = {}
    for c in ("size", "target", "taken", "times", "finish"):
        name = f"mix_{c}"
        while name in names:
            name += "_"
        added[name] = c
    return mixed.where("taken > 0").select(*(F.col("row")[c].alias(c) for c in names), *(F.col(c).alias(n) for n, c in added.items()))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can express neither the models nor the signatures; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
