"""Exact quantiles of groups of any size by radix selection: no buffer and no window holds a group's values.

A double's bits, with those of negative numbers turned round, are a whole number of the same order. Equal values meet first, as counts.
Three passes look at ever longer prefixes of that number: a histogram of prefixes (partial sums before the shuffle) tells in which
bucket each wanted rank lies, and only rows of wanted buckets go on to the next pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.session import cut

#: Low bits that a pass leaves open. The first histogram has at most 2**20 buckets a group, the others at most 2**22 for each wanted bucket.
SHIFTS = (44, 22, 0)
#: Up to so many distinct values in all groups together, the last pass alone is as good.
FEW = 1 << 20


def ordered_bits(c: Column) -> Column:
    """A long that orders as the double does."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c.cast("double")).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def exact_quantiles(df: DataFrame, by: str | Sequence[str], value: str | Column, shares: Sequence[float]) -> DataFrame:
    """``by`` (one or more columns, or none), q (array of the linear quantiles at ``shares``), mean and n of the values; NULL and NaN do not count.

    Null groups are groups; groups without values have no row.
    """
    by = [by] if isinstance(by, str) else list(by)
    value = F.col(value) if isinstance(value, str) else value
    group = F.struct(*by) if by else F.struct(F.lit(1).alias("_all"))
    x = df.select(group.alias("g"), value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    counts = x.groupBy("g", "v").agg(F.count("*").alias("c"))
    counts = cut(counts.withColumn("k", ordered_bits(F.col("v"))).select("g", "v", "c", *(F.shiftright("k", s).alias(f"p{i}") for i, s in enumerate(SHIFTS))))
    passes = range(len(SHIFTS))[-1 if counts.count() <= FEW else 0 :]
    totals = counts.groupBy("g").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(s))).alias("at")) for i, s in enumerate(shares))))
    asked = totals.select("g", at.alias("w")).select("g", "w.i", (F.col("w.at") - F.floor("w.at")).alias("part"), F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("rank"))
    rows, found = counts, ["g"]
    for i in passes:
        p = f"p{i}"
        held = rows.groupBy(*found, p).agg(F.sum("c").alias("t"), F.max("v").alias("v"))
        first = F.coalesce(F.sum("t").over(Window.partitionBy(*found).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = asked.join(held.withColumn("first", first), found).filter("rank >= first and rank < first + t")
        asked = met.select(*found, p, "i", "part", (F.col("rank") - F.col("first")).alias("rank"), "v")
        found.append(p)
        if i + 1 < len(SHIFTS):
            rows = rows.join(asked.select(*found).distinct(), found)
            asked = asked.drop("v")
    each = asked.groupBy("g", "i").agg((F.min("v") + (F.max("v") - F.min("v")) * F.max("part")).alias("q"))
    q = each.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))  # one entry a share
    return q.join(totals, "g").select(*(F.col(f"g.{c}").alias(c) for c in by), "q", "mean", "n")


def with_quantiles(summary: DataFrame, df: DataFrame, by: str, value: str | Column, named: Mapping[str, float]) -> DataFrame:
    """``summary`` (one row for each ``by``) with exact quantiles of ``value`` as further columns, null where a group has no value."""
    q = exact_quantiles(df, by, value, list(named.values()))
    q = q.select(F.col(by).alias("_by"), *(F.col("q")[i].alias(name) for i, name in enumerate(named)))
    return summary.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
