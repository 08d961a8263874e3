"""Intervals: overlap joins, unions, gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlaps(df: DataFrame, key: str, uid: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of one key whose half-open intervals overlap, each once. Intervals are cut into bins of ``width`` and met by an
    equi-join on (key, bin); a pair belongs to the bin where the later one of them starts."""
    binned = df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.greatest(F.floor(F.col(start) / width), F.ceil(F.col(end) / width) - 1))))
    a = binned.select(F.col(key), "_bin", F.col(uid).alias("left_id"), F.col(start).alias("_s1"), F.col(end).alias("_e1"))
    b = binned.select(F.col(key), "_bin", F.col(uid).alias("right_id"), F.col(start).alias("_s2"), F.col(end).alias("_e2"))
    met = a.join(b, [key, "_bin"]).filter("left_id < right_id and _s1 < _e2 and _s2 < _e1")
    return met.filter(F.col("_bin") == F.floor(F.greatest("_s1", "_s2") / width)).select(key, "left_id", "right_id")


def checked_overlaps(df: DataFrame, key: str, uid: str, start: str, end: str, width: float) -> tuple[DataFrame, DataFrame]:
    """Rows whose interval is none (a bound missing, not finite, before 0, or an end that is not after the start), and the overlapping pairs of the others."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ok = F.coalesce(finite(start) & finite(end) & (F.col(start) >= 0) & (F.col(end) > F.col(start)), F.lit(False))
    return df.filter(~ok), overlaps(df.filter(ok), key, uid, start, end, width)


def islands(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Merged intervals of each key, as start and end; touching ones merge."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
