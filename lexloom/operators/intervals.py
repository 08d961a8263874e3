"""Statistics of ratios over clusters: delete-one jackknife, Student's t, bootstrap, verdicts."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.expr import hash01
from lexloom.operators.ranks import running
from lexloom.session import cut

#: Draws of a bootstrap that one task makes.
DRAWS = 1 << 20


def _upper(t: float, df: int) -> float:
    """P(T > t) by Simpson's rule over the angle: T = sqrt(df) tan(a) has a density proportional to cos(a)**(df - 1)."""
    a = np.linspace(-math.pi / 2, math.pi / 2, 20001)
    w = np.cos(a) ** (df - 1)
    w[[0, -1]] *= 0.5
    b = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 20001)
    v = np.cos(b) ** (df - 1)
    v[[0, -1]] *= 0.5
    return float(v.sum() * (b[1] - b[0]) / (w.sum() * (a[1] - a[0])))


@cache
def t_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _upper(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def cluster_sums(df: DataFrame, by: list[str], cluster: str, num: Column, den: Column) -> DataFrame:
    return df.groupBy(*by, cluster).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))


def leave_one_out(sums: DataFrame, by: list[str]) -> DataFrame:
    """Each cluster's estimate without it. Window frames run over one row a cluster."""
    w = Window.partitionBy(*by)
    rest = F.sum("den").over(w) - F.col("den")
    return sums.withColumn("estimate", F.sum("num").over(w) / F.sum("den").over(w)).withColumn("leave", F.when(rest != 0, (F.sum("num").over(w) - F.col("num")) / rest))


def jackknife(sums: DataFrame, by: list[str]) -> DataFrame:
    """Estimate, number of clusters and standard error of each group."""
    loo = leave_one_out(sums, by)
    n = F.count("leave")
    return loo.groupBy(*by).agg(F.first("estimate").alias("estimate"), F.count("*").alias("clusters"), F.when(n > 1, F.sqrt((n - 1) * F.var_pop("leave"))).alias("error"))


def interval(df: DataFrame, level: float = 0.95) -> DataFrame:
    """low and high from error and clusters; quantiles for the few degrees of freedom that occur are computed on the driver."""
    degrees = [r[0] for r in df.select("clusters").distinct().collect()]  # one row for each size of a comparison
    table = {d: t_quantile(1 - (1 - level) / 2, d - 1) for d in degrees if d > 1}
    t = F.coalesce(*(F.when(F.col("clusters") == d, F.lit(q)) for d, q in table.items()), F.lit(None).cast("double")) if table else F.lit(None).cast("double")
    return df.withColumn("low", F.col("estimate") - t * F.col("error")).withColumn("high", F.col("estimate") + t * F.col("error"))


def verdict(low: Column, high: Column, better: str = "higher") -> Column:
    gain = (low > 0) if better == "higher" else (low < 0)
    return F.when(low.isNull() | high.isNull(), "n/a").when((low <= 0) & (high >= 0), "tie").when(gain, "win").otherwise("loss")


def picks(rows: DataFrame, by: list[str], draws: int, seed: int = 0) -> DataFrame:
    """by, replicate, place: what the clusters' replicates draw, from by, place and n (the group's size); as many rows as clusters times ``draws``.

    Clusters are few next to their draws, so they are dealt by (group, place) before they are drawn for, into partitions counted by draws and not by bytes.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * draws // DRAWS))
    slots = rows.select(*by, "place", "n").repartition(parts, *by, "place").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = hash01(F.lit(str(seed)), *(F.col(c).cast("string") for c in by), F.col("replicate").cast("string"), F.col("place").cast("string"))
    pick = F.coalesce(F.floor(u * F.col("n")).cast("long"), F.lit(-1))  # never null: a join would hash once more to filter nulls
    return slots.select(*by, "replicate", pick.alias("place"))


def bootstrap(sums: DataFrame, by: list[str], cluster: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """by, replicate, estimate: ratios of resampled clusters, as many clusters a replicate as the group has, with replacement.

    Clusters have places in their group (by the SHA-256 of their name, in two levels, so a group of any size is spread), and each of a replicate's draws is
    a hash, so that no task holds a group and reruns agree. The shuffle carries one small row for each draw, which a task looks up in its share of the
    clusters; sums are taken before the last one.
    """
    name = hash01(F.lit(str(seed)), F.col(cluster).cast("string"))
    rows = cut(running(sums.select(*by, cluster, "num", "den").withColumn("h", name), by, F.floor(F.col("h") * 1024), ["h", cluster], F.lit(1), "place", "n"))
    drawn = picks(rows, by, draws, seed).join(rows.select(*by, "place", "num", "den").hint("shuffle_hash"), [*by, "place"])
    return drawn.groupBy(*by, "replicate").agg((F.sum("num") / F.nullif(F.sum("den"), F.lit(0))).alias("estimate"))


def percentile_interval(drawn: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """by, low, high: quantiles of the replicates' estimates, of which a group has as many as were drawn."""
    q = F.percentile("estimate", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return drawn.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def covered(sums: DataFrame, corpus: str, cluster: str, draws: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """method, covered, n: share of corpora (parts of one table) whose jackknife and percentile intervals hold the ratio of the whole table."""
    sums = cut(sums)
    whole = F.broadcast(sums.agg((F.sum("num") / F.sum("den")).alias("truth")))  # one row
    t = interval(jackknife(sums, [corpus]), level).select(corpus, F.lit("jackknife_t").alias("method"), "low", "high")
    p = percentile_interval(bootstrap(sums, [corpus], cluster, draws, seed), [corpus], level).select(corpus, F.lit("percentile").alias("method"), "low", "high")
    hit = F.coalesce(F.col("truth").between(F.col("low"), F.col("high")), F.lit(False))
    return t.union(p).crossJoin(whole).groupBy("method").agg(F.avg(hit.cast("double")).alias("covered"), F.count("*").alias("n"))
