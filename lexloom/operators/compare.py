"""Comparing systems: replicates, pairs, scorer gates, key sets, gates with intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators import intervals as I
from lexloom.session import cut


def replicates(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Seeds of one item averaged before any statistic."""
    return rows.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))


def against(items: DataFrame, system: str, baseline: str, keys: Sequence[str], cluster: str, better: str = "higher", level: float = 0.95) -> DataFrame:
    """system, delta, clusters, pairs, only_baseline, only_system, low, high, verdict of every other system against ``baseline``.

    Pairs are equal keys on both sides; the jackknife runs over one row a cluster. A system without a common item is an error.
    """
    items = cut(items)
    base = items.filter(F.col(system) == baseline).select(*keys, F.col("num").alias("an"), F.col("den").alias("ad"))
    other = items.filter(F.col(system) != baseline).withColumnRenamed("num", "bn").withColumnRenamed("den", "bd")
    both = other.join(base, list(keys))
    sums = both.groupBy(system, cluster).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("an", "ad", "bn", "bd")))
    w = Window.partitionBy(system)
    t = {c: F.sum(c).over(w) for c in ("an", "ad", "bn", "bd")}
    leave = (t["bn"] - F.col("bn")) / (t["bd"] - F.col("bd")) - (t["an"] - F.col("an")) / (t["ad"] - F.col("ad"))
    loo = sums.withColumn("estimate", t["bn"] / t["bd"] - t["an"] / t["ad"]).withColumn("leave", leave)
    n = F.count("leave")
    jack = loo.groupBy(system).agg(F.first("estimate").alias("estimate"), F.count("*").alias("clusters"), F.sum("n").alias("pairs"), F.when(n > 1, F.sqrt((n - 1) * F.var_pop("leave"))).alias("error"))
    counts = other.groupBy(system).agg(F.count("*").alias("mine"))
    lone = counts.join(jack.select(system), system, "left_anti").first()
    if lone:
        raise ValueError(f"{lone[0]}: nothing in common with the baseline")
    all_base = base.count()
    out = I.interval(jack, level).join(counts, system)
    return out.select(
        system, F.col("estimate").alias("delta"), "clusters", "pairs", (F.lit(all_base) - F.col("pairs")).alias("only_baseline"), (F.col("mine") - F.col("pairs")).alias("only_system"),
        "low", "high", I.verdict(F.col("low"), F.col("high"), better).alias("verdict"),
    )


def scorer_differences(rows: DataFrame, system: str, evaluator: str) -> DataFrame:
    """name, system, values: settings (a map column) of which several values occur anywhere; sets are small and unite before the shuffle."""
    pairs = rows.select(system, F.explode(evaluator).alias("name", "value")).distinct()
    many = pairs.groupBy("name").agg(F.count_distinct("value").alias("n")).filter("n > 1").select("name")
    return pairs.join(F.broadcast(many), "name").groupBy("name", system).agg(F.sort_array(F.collect_set("value")).alias("values"))


def check_scorers(rows: DataFrame, system: str, evaluator: str, allow: bool = False) -> list[str]:
    """Notes; different scorers are an error unless allowed."""
    found = scorer_differences(rows, system, evaluator).orderBy("name", system).collect()  # a line for each system and setting
    notes = []
    if found:
        detail = ", ".join(f"{r['name']}: {r[system]}={'|'.join(r['values'])}" for r in found)
        if not allow:
            raise ValueError(f"the systems were scored differently ({detail})")
        notes.append(f"scorer mismatch allowed: {detail}")
    unknown = [r[0] for r in rows.filter(F.col(evaluator).isNull()).select(system).distinct().orderBy(system).collect()]
    if unknown:
        notes.append(f"rows of {', '.join(unknown)} carry no scorer identity")
    return notes


def key_states(a: DataFrame, b: DataFrame, keys: Sequence[str], changed: Column) -> DataFrame:
    """Every key of either side with state: only_left, only_right, changed or same."""
    left, right = a.withColumn("_l", F.lit(True)), b.withColumn("_r", F.lit(True))
    state = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(changed, "changed").otherwise("same")
    return left.join(right, list(keys), "full").withColumn("state", state).drop("_l", "_r")


def gate(before: DataFrame, after: DataFrame, keys: Sequence[str], cluster: str, metrics: Sequence[str], same: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """metric, delta, low, high of a strict before and after: equal keys and equal ``same`` columns, finite metrics, no repeated key, two clusters at least."""
    a = cut(before.select(*keys, cluster, *(F.col(c).alias(f"{c}_a") for c in (*metrics, *same))))
    b = cut(after.select(*keys, *(F.col(c).alias(f"{c}_b") for c in (*metrics, *same))))
    for side in (a, b):
        if side.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise ValueError("duplicate evaluation key")
    finite = [F.abs(F.col(f"{m}_{s}")) < float("inf") for m in metrics for s in ("a", "b")]
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    broken = F.lit(False)
    for f in finite:
        broken = broken | ~F.coalesce(f, F.lit(False))
    states = cut(key_states(a, b, keys, changed).withColumn("broken", broken))
    bad = states.filter("state <> 'same' or broken").select("state", "broken").first()
    if bad:
        raise ValueError(f"evaluations differ in keys ({bad['state']})" if bad["state"].startswith("only") else "reference data changed between evaluations" if bad["state"] == "changed" else "a metric is not finite")
    deltas = F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_b") - F.col(f"{m}_a")).cast("double").alias("d")) for m in metrics)))
    sums = I.cluster_sums(states.select(cluster, deltas), ["metric"], cluster, F.col("d"), F.lit(1.0))
    out = I.interval(I.jackknife(sums, ["metric"]), level).withColumnRenamed("estimate", "delta")
    if out.filter("clusters < 2").limit(1).count():
        raise ValueError("at least two clusters are needed")
    return out.select("metric", "delta", "clusters", "low", "high")
