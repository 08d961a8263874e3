"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A document's size is its number of ``[^\\x20\\x09-\\x0D]+`` (null: 0). Sources in code point order, null
last, weigh 5, 2, 1, repeating, and share all words; a source's target stops at ``limit`` times its size
and the excess is reshared by weight until none is above: ``target = min(level * weight, limit * size)``
with the one level that spends everything.

Each document of a source expects ``target / size of the source`` copies. The prefix sum of these over
the source, plus one offset drawn from the seed and the source's name, crosses integers; a document is
emitted once for each integer it crosses, hence at most ``limit`` times. Documents are visited by size
class, so that each class is sampled evenly and the taken words come near the target.

The prefix sum is taken in two levels, over about sqrt(n) buckets in each class and within a bucket, so
that no task holds a source. Reruns agree: within a bucket rows come by size, doc_id and a digest of the text, then of the carried
columns, so rows that differ at all have one order, whatever the partitions.

Edge cases: null or wordless texts have size 0, null sources form one source, null doc_ids are ordinary
rows and spread by their text; rows that repeat each other are sampled one by one; a very long text is one row, of which only its size and
digest are sorted; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.session import cut

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, limit: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> also weight and target. One row for each source goes in, so one task sorts them."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long")
    table = sizes.withColumn("weight", weight).withColumn("_cap", limit * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    fits = table.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("weight") <= F.col("_cap"))
    # from the first source that the level does not fill on, this level holds
    return fits.withColumn("_at", F.first(F.when(F.col("_open"), F.col("_level")), True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(
        "source", "source_size", "weight", F.when(F.col("_open"), F.col("_at") * F.col("weight")).otherwise(F.col("_cap").cast("double")).alias("target")
    )


def uniform(name: str, seed: str):
    """A number in [0, 1) from the seed and a column's value."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(name), F.lit(""))), 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix_sources(docs: DataFrame, seed: str = "mix", limit: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row; ``keep`` names further columns to carry."""
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0))
    digest = F.md5(F.coalesce("text", F.lit("")))
    slim = docs.select("doc_id", "source", F.when(F.col("text").isNull(), 0).otherwise(size).cast("long").alias("size"), digest.alias("_digest"), *keep)
    slim = cut(slim.withColumn("_class", F.length(F.bin("size"))))
    n = F.broadcast(slim.agg(F.greatest(F.ceil(F.sqrt(F.count("*")) / 8), F.lit(1)).cast("long").alias("_n")))  # one row
    rows = slim.join(n).withColumn("_bucket", F.coalesce(F.pmod("doc_id", "_n"), F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") % F.col("_n"))).drop("_n")
    part = ["source", "_class", "_bucket"]
    cells = rows.groupBy(*part).agg(F.count("*").alias("_rows"), F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
    table = targets(cells.groupBy("source").agg(F.sum("_words").alias("source_size")), limit).withColumnRenamed("source", "_source")
    cells = cells.join(table, F.col("source").eqNullSafe(F.col("_source"))).select(*(F.col(c).alias(f"_{c}") for c in part), "_ahead", "source_size", "target")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*part).orderBy("size", "doc_id", "_digest", F.xxhash64(*keep) if keep else F.lit(0))))
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("__class")) & (F.col("_bucket") == F.col("__bucket"))
    placed = ranked.join(cells, on)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    last, offset = F.col("_ahead") + F.col("_rank"), uniform("source", seed)
    copies = F.floor(rate * last + offset) - F.floor(rate * (last - 1) + offset)
    return placed.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *keep)
