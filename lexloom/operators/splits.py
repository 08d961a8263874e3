"""Splits that divide neither a voice nor an episode, held-out checks, round-robin pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.expr import hash01, split_of
from lexloom.operators import graph
from lexloom.session import cut

#: Stretches of a group's seeded order that are sorted on their own.
STRETCHES = 1024


def joined_groups(labels: DataFrame, label: str, *keys: str) -> DataFrame:
    """label, group: labels that share any key, directly or through others, have one group (the least label).

    Labels hang on their keys as on nodes of their own, so a key of many labels costs a row each, never a pair.
    """
    nodes = labels.select(F.concat(F.lit("l:"), F.col(label).cast("string")).alias("u"), *keys)
    edges = None
    for i, k in enumerate(keys):
        part = nodes.filter(F.col(k).isNotNull()).select("u", F.concat(F.lit(f"{i}:"), F.col(k).cast("string")).alias("v"))
        edges = part if edges is None else edges.union(part)
    comp = graph.components(edges)
    rows = nodes.select("u").join(comp, F.col("u") == F.col("node"), "left").select("u", F.coalesce("comp", "u").alias("c"))
    least = rows.groupBy("c").agg(F.min("u").alias("g"))
    return rows.join(least, "c").select(F.substring("u", 3, 1 << 20).alias(label), F.substring("g", 3, 1 << 20).alias("group"))


def split_map(labels: DataFrame, label: str, split: str, rows: str, keys: tuple[str, ...], policy: str = "keep-train", seed: int = 0) -> DataFrame:
    """label, mapped: one split for each group of labels.

    ``keep-train``: a group with a train label goes to train, else the held-out split with more rows wins, test on ties. ``hash``: the
    least key of the group (the last of ``keys``) decides afresh.
    """
    if policy not in ("keep-train", "hash"):
        raise ValueError("policy must be keep-train or hash")
    groups = cut(joined_groups(labels, label, *keys))
    both = labels.withColumn(label, F.col(label).cast("string")).join(groups, label)
    test, val = (F.sum(F.when(F.col(split) == s, F.col(rows)).otherwise(0)) for s in ("test", "val"))
    if policy == "hash":
        mapped = split_of(F.min(F.coalesce(F.col(keys[-1]).cast("string"), F.col(label))), seed)
    else:
        mapped = F.when(F.max((F.col(split) == "train").cast("int")) == 1, "train").when(test >= val, "test").otherwise("val")
    return both.select(label, "group").join(both.groupBy("group").agg(mapped.alias("mapped")), "group").select(label, "mapped")


def not_held_out(train: DataFrame, held: DataFrame, uid: str, speaker: str) -> DataFrame:
    """Training rows whose id or speaker is held out: two semi joins, no OR."""
    by_id = train.join(held.select(uid).distinct(), uid, "left_semi")
    by_speaker = train.join(held.select(speaker).distinct(), speaker, "left_semi")
    return by_id.unionByName(by_speaker).distinct()


def round_robin(rows: DataFrame, speaker: str, uid: str, count: int, seed: int = 0) -> DataFrame:
    """speaker, uid, prompt: targets taken from the speakers in turn, each at most once; the prompt is the speaker's next row in the same order.

    Only speakers with two rows and more take part.
    """
    h = hash01(F.lit(str(seed)), F.col(uid).cast("string"))
    w = Window.partitionBy(speaker).orderBy("h", uid)
    x = rows.select(speaker, uid, h.alias("h")).withColumn("k", F.row_number().over(w)).withColumn("next", F.lead(uid).over(w))
    ends = x.groupBy(speaker).agg(F.min_by(uid, "k").alias("head"), F.count("*").alias("n")).filter("n > 1")
    x = x.join(ends, speaker).withColumn("prompt", F.coalesce("next", "head"))
    return x.orderBy("k", hash01(F.lit(str(seed)), F.col(speaker).cast("string")), speaker).limit(count).select(speaker, uid, "prompt")


def circular_partner(rows: DataFrame, group: str, uid: str, seed: int, eligible: Column | None = None) -> DataFrame:
    """group, uid, partner: the next eligible row of the group in a seeded order, the first after the last, never the row itself.

    Stretches of the order are sorted on their own, each row sees what comes after it as a running value from the end, and a table of
    the stretches' first rows joins them, so that no task holds a group of any size and the work is linear.
    """
    h = hash01(F.lit(str(seed)), F.col(group).cast("string"), F.col(uid).cast("string"))
    x = rows.select(group, uid, h.alias("h"), (F.lit(True) if eligible is None else eligible).alias("ok")).withColumn("_b", F.floor(F.col("h") * STRETCHES))
    after = Window.partitionBy(group, "_b").orderBy(F.desc("h"), F.desc(uid)).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("next", F.last(F.when(F.col("ok"), F.col(uid)), ignorenulls=True).over(after))
    firsts = x.groupBy(group, "_b").agg(F.min(F.when(F.col("ok"), F.struct("h", uid))).alias("first"))
    later = Window.partitionBy(group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    head = F.coalesce(F.last("first", ignorenulls=True).over(later), F.min("first").over(Window.partitionBy(group)))[uid]
    firsts = firsts.select(F.col(group).alias("_g"), F.col("_b").alias("_gb"), head.alias("head"))
    met = x.join(firsts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_gb")))
    return met.select(group, uid, F.coalesce("next", "head").alias("partner")).filter(F.col("partner") != F.col(uid))


def previous(rows: DataFrame, group: str, uid: str) -> DataFrame:
    """group, uid, before: the row before each one of its group in the order of ``uid`` (a whole number), by stretches of ids and a table of their last rows."""
    x = rows.select(group, uid, F.shiftright(F.col(uid).cast("long"), 16).alias("_b"))
    x = x.withColumn("before", F.lag(uid).over(Window.partitionBy(group, "_b").orderBy(uid)))
    lasts = x.groupBy(group, "_b").agg(F.max(uid).alias("last"))
    ahead = F.lag("last").over(Window.partitionBy(group).orderBy("_b"))
    lasts = lasts.select(F.col(group).alias("_g"), F.col("_b").alias("_gb"), ahead.alias("ahead"))
    met = x.join(lasts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_gb")))
    return met.select(group, uid, F.coalesce("before", "ahead").alias("before"))
