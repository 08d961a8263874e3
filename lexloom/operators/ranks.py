"""Ranks and prefix sums over keys that may hold any share of the rows, in two levels.

Rows of a key are spread over buckets by a hash; a window runs within (key, bucket), and the buckets' totals
are summed up over the key. With about sqrt(n) buckets neither level has more than about sqrt(n) rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, name: str, whole: str | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (positive integers) over the key's rows before this one, by (bucket, order); with ``whole``, if named: the sum over all of the key's rows."""
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"), F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_ahead"), *([F.sum("_t").over(Window.partitionBy(*keys)).alias("_whole")] if whole else []))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    on = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(totals, on).withColumn(name, (F.col("_ahead") + F.col("_own")).cast("long")).select(*df.columns, name, *([F.col("_whole").alias(whole)] if whole else []))
