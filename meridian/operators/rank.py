"""Row numbers of a global order, and blocks of them, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import cut


def ranked(rows: DataFrame, *order: str | Column, rank: str = "rank") -> DataFrame:
    """rows with their number from 0 in an order: a range sort, then each partition's start from the partitions' sizes (a number a partition reaches the driver)."""
    columns = rows.columns

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*columns, "part_", "at_"])
            at += n

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = cut(dealt.mapInArrow(numbered, StructType([*dealt.schema.fields]).add("part_", "integer").add("at_", "long")), "ranked")
    sizes = sorted(table.groupBy("part_").count().collect())
    starts = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).tolist()
    if not sizes:
        return table.select(*columns, F.col("at_").alias(rank))
    start = F.create_map(*(F.lit(x) for (p, _), s in zip(sizes, starts, strict=False) for x in (p, int(s))))
    return table.select(*columns, (start[F.col("part_")].cast("long") + F.col("at_")).alias(rank))
