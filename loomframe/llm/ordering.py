"""Global positions of sorted rows without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import written


def numbered(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """`df` with the 0-based position of each row by `order`, nulls first.

    Rows are range-partitioned and sorted, and their (partition, row) numbers
    written with them, so that a retried task cannot number them anew. Only one
    count for each partition is then summed up and broadcast: its size is the
    number of partitions. Ties in `order` get adjoining numbers.
    """
    at = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return at.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, row + F.col("_before")).drop("_at", "_part", "_before")


def running_sum(df: DataFrame, value: str, *order: str, name: str = "start", ordinal: str = "ordinal") -> DataFrame:
    """`df` with the sum of `value` over all rows before each row by `order`, and its 0-based position; rows should be narrow."""
    at = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "summed")
    at = at.withColumn("_part", F.shiftright("_at", 33))
    sums = at.groupBy("_part").agg(F.sum(value).alias("_v"), F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(b) for c, b in (("_v", "_value"), ("_n", "_rows"))])
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(before), "_part").withColumns({name: own + F.col("_value"), ordinal: row + F.col("_rows")}).drop("_at", "_part", "_value", "_rows")
