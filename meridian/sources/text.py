"""Text forms: tab-separated vectors with metadata, and tolerant CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """meta, embedding of lines such as ``name<TAB>1|2|3``."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].alias("meta"), F.transform(F.split(parts[1], r"\|"), lambda x: x.cast("float")).alias("embedding"))


def tolerant(column: Column) -> Column:
    """A number, or NaN for what isn't one."""
    return F.coalesce(column.try_cast("double"), F.lit(float("nan")))


def read_tolerant_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(tolerant(F.col(c)).alias(c) if c in numbers else F.col(c) for c in rows.columns))


def append_csv(rows: DataFrame, path: str) -> None:
    """More part files in a folder of CSV, each with its header."""
    rows.write.mode("append").option("header", True).csv(path)


def recover(rows: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of points that were completed; those of an interrupted point go."""
    return rows.join(completed.select(*keys).distinct(), keys, "left_semi")
