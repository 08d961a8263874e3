"""A bit sieve: rows that cannot be wanted leave before a shuffle.

The bits of the wanted ids' hashes take at most ``BITS / 64`` rows whatever the input, so they may be
broadcast. Ids that share a bit pass too; an exact join decides afterwards. A full sieve only saves less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 22


def marked(df: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: whether ``key`` may be among the first column of ``wanted``."""

    def at(c):
        return F.pmod(F.xxhash64(c), F.lit(BITS))

    bits = wanted.select(at(F.col(wanted.columns[0])).alias("_at")).selectExpr("cast(_at / 64 as int) as _word", "shiftleft(1L, cast(_at % 64 as int)) as _bit").groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    mine = df.withColumn("_at", at(F.col(key))).withColumn("_word", (F.col("_at") / 64).cast("int"))
    hit = F.expr("(shiftrightunsigned(coalesce(_bits, 0L), cast(_at % 64 as int)) & 1) = 1")
    return mine.join(F.broadcast(bits), "_word", "left").withColumn(name, hit).select(*df.columns, name)


def sieve(df: DataFrame, key: str, wanted: DataFrame, inverse: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among the first column of ``wanted``; ``inverse``: those that are surely not."""
    out = marked(df, key, wanted, "_hit")
    return out.filter("not _hit" if inverse else "_hit").select(*df.columns)
