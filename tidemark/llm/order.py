"""Places in a total order over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

_IN_PARTITION = (1 << 33) - 1


def in_order(df: DataFrame, order: list[Column], name: str, keep: list[str] | None = None) -> DataFrame:
    """df with `__at`, the place (from 0, gapless) of each row in the order given; ties come in any order.

    keep is the columns to return, by default all. Ranges of the order are sorted side by side and written to the shared folder; a row's place is its place in
    its range and the number of rows in the ranges before it, one number a range. Rows that tie are spread over
    ranges like others, so that a value of a third of all rows is no single task's.
    """
    rows = df.withColumn("__tie", F.monotonically_increasing_id())
    order = [*order, F.col("__tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("__range", F.spark_partition_id()).withColumn(
        "__at", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))
    )
    rows = written(rows.select(*(keep or df.columns), "__range", "__at"), name)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    out = rows.join(F.broadcast(starts), "__range")  # as many rows as the shuffle has partitions
    return out.withColumn("__at", F.col("__at") + F.col("__start")).drop("__range", "__start")
