"""Tables in the folder that all executors share: where lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in spark.checkpoint.dir, which goes when the driver ends; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/meridian-scratch"
    path = f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """df as a table written once: lineage ends there, and lost executors don't matter."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession, *tables: DataFrame | str | None) -> None:
    """Delete tables of cut(), or paths, that nothing reads any more, and let shuffles and broadcasts of finished jobs go, which else stay until the driver's garbage is collected."""
    for one in tables:
        if path := one if isinstance(one, str) else getattr(one, "_scratch", None):
            drop_path(spark, path)
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
