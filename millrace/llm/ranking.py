"""Row numbers over a whole table, without one task that sees all rows."""

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import stage


def starts(parts: DataFrame, part: str, amount: str) -> DataFrame:
    """``part`` and start, the sum of ``amount`` over all smaller parts. One row per part goes through a task."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(part, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long").alias("start"))


def numbered(df: DataFrame, order: list, out: str, tasks: int) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in ``order`` over all rows; ties get different numbers.

    Rows are dealt to ``tasks`` ranges of the order, sorted and numbered there, written to the shared
    folder, and each range adds the number of rows in the ranges before it.
    """
    schema = T.StructType(df.schema.fields).add("_part", T.IntegerType()).add("_at", T.LongType())

    def work(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(n + 1, n + 1 + b.num_rows), pa.int64())],
                names=[*b.schema.names, "_part", "_at"])
            n += b.num_rows

    rows = stage(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(work, schema), "numbered")
    sizes = rows.groupBy("_part").agg(F.max("_at").alias("n"))
    return (rows.join(starts(sizes, "_part", "n"), "_part")
            .withColumn(out, F.col("_at") + F.col("start")).drop("_part", "_at", "start"))
