"""Places in a global order, at any size: ranges of sampled keys are sorted on their own, and their counts give each its first place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.session import cut

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` (whose partitions come in order, and whose plan reads them as they are) with the number of each row, from 0."""
    ids = df.withColumn("_id", F.monotonically_increasing_id())  # the partition's number above 33 bits of the row's
    part = F.shiftright("_id", 33)
    sizes = ids.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", ahead.alias("_ahead")))  # one row a partition
    return ids.join(starts, part == F.col("_part")).withColumn(name, F.col("_ahead") + F.col("_id").bitwiseAND(_ROW)).drop("_id", "_part", "_ahead")


def places(df: DataFrame, *keys: str | Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``keys``, which should tell rows apart: equal ones share a range, in any order."""
    return numbered(cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)), name)
