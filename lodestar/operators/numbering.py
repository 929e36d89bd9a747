"""A running index over a whole table, without a window over all rows.

Rows are dealt by ranges of their order and sorted within; each task numbers its own,
and one row for each task says how many came before. Ties are told apart by
all that is known of a row, so the index depends on the rows alone, but for
rows that are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.store import stored

#: monotonically_increasing_id() has the task above these bits and the row within it below.
_ROW_BITS = 33


def indexed(rows: DataFrame, order: list[Column | str], name: str = "idx") -> DataFrame:
    """rows with name: 0, 1, ... in the given order. What the order is of must outlast a second read."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(stored(rows).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", _ROW_BITS).alias("_task")
    counts = placed.groupBy(task).agg(F.count("*").alias("n"))  # a row for each task
    before = counts.select("_task", F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn("_task", task).join(F.broadcast(before), "_task").withColumn(name, (F.col("_before") + within).cast("long")).drop("_at", "_task", "_before")
