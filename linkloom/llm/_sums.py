"""Element-wise sums of large count tables across partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of tasks whose tables are added first.
GROUPS = 32


def summed(parts: DataFrame, dtype, tasks: int | None = None) -> DataFrame:
    """(chunk, counts) of rows (chunk long, counts binary): each chunk's arrays added up, floats in double precision.

    Tasks are added in GROUPS first and the groups then, so that no task reads a chunk of
    every task at once. Where no more than GROUPS tasks are known to send, that step is left out.
    """
    wide = np.float64 if np.issubdtype(dtype, np.floating) else dtype

    def adder(kind):
        def add(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    values = np.frombuffer(counts, kind).astype(wide)
                    total[chunk] = total[chunk] + values if chunk in total else values
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

        return add

    schema = "chunk long, counts binary"
    if tasks is not None and tasks <= GROUPS:
        return parts.repartition("chunk").mapInArrow(adder(dtype), schema)
    grouped = parts.withColumn("of", F.spark_partition_id() % GROUPS).repartition("chunk", "of").select("chunk", "counts").mapInArrow(adder(dtype), schema)
    return grouped.repartition("chunk").mapInArrow(adder(wide), schema)
