"""Best-of-N, preference pairs, group advantages, judges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.plans.registry import query, table

REWARD = "(-2 * least(l_discount * 20, 2) - least(l_tax * 10, 2) + 0.5 * (l_quantity - 1) / 49)"


def candidates(spark, sf, digits=6):
    reward = -2 * F.least(F.col("l_discount") * 20, F.lit(2.0)) - F.least(F.col("l_tax") * 10, F.lit(2.0)) + 0.5 * (F.col("l_quantity") - 1) / 49
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (reward if digits is None else F.round(reward, digits)).alias("reward"))


@query(f"WITH c AS (SELECT l_orderkey, l_linenumber, {REWARD} AS reward FROM lineitem) SELECT l_orderkey, min_by(reward, (l_linenumber, reward)) AS first, avg(reward) AS mean, max(reward) AS best, count(*) AS n FROM c GROUP BY 1")
def best_of_n(spark, sf):
    return candidates(spark, sf, None).groupBy("l_orderkey").agg(F.min_by("reward", F.struct("l_linenumber", "reward")).alias("first"), F.avg("reward").alias("mean"), F.max("reward").alias("best"), F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, round({REWARD}, 6) AS reward FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY reward DESC, l_linenumber) AS top, row_number() OVER (PARTITION BY l_orderkey ORDER BY reward, l_linenumber DESC) AS low FROM c)
SELECT w.l_orderkey, w.l_linenumber AS winner, l.l_linenumber AS loser, w.reward - l.reward AS margin FROM r w JOIN r l ON w.l_orderkey = l.l_orderkey AND w.top = 1 AND l.low = 1 WHERE w.reward - l.reward >= 0.5""")
def preference_pairs(spark, sf):
    """Best and worst of a group by one aggregate, with a margin."""
    g = candidates(spark, sf).groupBy("l_orderkey").agg(F.max(F.struct("reward", (-F.col("l_linenumber")).alias("i"))).alias("w"), F.min(F.struct("reward", (-F.col("l_linenumber")).alias("i"))).alias("l"))
    return g.select("l_orderkey", (-F.col("w.i")).alias("winner"), (-F.col("l.i")).alias("loser"), (F.col("w.reward") - F.col("l.reward")).alias("margin")).filter("margin >= 0.5")


@query(f"WITH c AS (SELECT l_orderkey, l_linenumber, round({REWARD}, 6) AS reward FROM lineitem) SELECT l_orderkey, l_linenumber, (reward - avg(reward) OVER w) / greatest(stddev_pop(reward) OVER w, 0.1) AS advantage FROM c WINDOW w AS (PARTITION BY l_orderkey)")
def group_advantage(spark, sf):
    """Group z-scores with a floor under the spread; a group is one order, a handful of rows."""
    w = Window.partitionBy("l_orderkey")
    return candidates(spark, sf).select("l_orderkey", "l_linenumber", ((F.col("reward") - F.avg("reward").over(w)) / F.greatest(F.stddev_pop("reward").over(w), F.lit(0.1))).alias("advantage"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_discount > 0 THEN l_discount END, max(CASE WHEN l_discount > 0 THEN l_discount END) OVER (PARTITION BY l_orderkey)) AS score FROM lineitem")
def worst_for_failed(spark, sf):
    """A failed score takes its group's worst."""
    x = F.when(F.col("l_discount") > 0, F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(x, F.max(x).over(Window.partitionBy("l_orderkey"))).alias("score"))


@query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer),
q AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN k <= 10 THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS r FROM g WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT c_custkey, c_mktsegment FROM q WHERE r <= 30""")
def balanced_topn(spark, sf):
    """A quota of 10 for each of two groups, filled up to 30 by the best of the rest."""
    c = table(spark, sf, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    k = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return c.withColumn("k", k).orderBy((F.col("k") > 10).cast("int"), F.desc("c_acctbal"), "c_custkey").limit(30).select("c_custkey", "c_mktsegment")


@query("SELECT source, contains(lower(source), 'src1') AS overlaps FROM documents GROUP BY ALL")
def distinct_families(spark, sf):
    """Distinct sources and whether they belong to a family."""
    return table(spark, sf, "documents").select("source", F.contains(F.lower("source"), F.lit("src1")).alias("overlaps")).distinct()
