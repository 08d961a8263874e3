"""Comparing systems: replicates, cluster sums, jackknife, paired deltas, strata, bootstrap, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import intervals as I
from lexloom.plans.comparing import T, drawn_sql
from lexloom.plans.registry import query, table
from lexloom.session import cut

SUMS = "s AS (SELECT l_returnflag AS system, l_suppkey AS cluster, sum(l_discount * l_quantity) AS num, sum(l_quantity) AS den FROM lineitem GROUP BY 1, 2)"


def sums(spark, sf, *by):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("stratum"), F.col("l_suppkey").alias("cluster"), "l_discount", "l_quantity")
    return I.cluster_sums(rows, list(by), "cluster", F.col("l_discount") * F.col("l_quantity"), F.col("l_quantity"))


@query("SELECT l_partkey, l_returnflag, avg(l_discount * l_quantity) AS num, avg(l_quantity) AS den, count(*) AS replicates FROM lineitem GROUP BY 1, 2")
def replicate_mean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.avg(F.col("l_discount") * F.col("l_quantity")).alias("num"), F.avg("l_quantity").alias("den"), F.count("*").alias("replicates"))


@query(f"WITH {SUMS} SELECT * FROM s")
def cluster_sums(spark, sf):
    return sums(spark, sf, "system")


@query(f"WITH {SUMS} SELECT system, cluster, sum(num) OVER w / sum(den) OVER w AS estimate, (sum(num) OVER w - num) / (sum(den) OVER w - den) AS leave FROM s WINDOW w AS (PARTITION BY system)")
def leave_one_cluster_out(spark, sf):
    return I.leave_one_out(sums(spark, sf, "system"), ["system"]).select("system", "cluster", "estimate", "leave")


JACK = f"""{SUMS}, l AS (SELECT system, sum(num) OVER w / sum(den) OVER w AS estimate, (sum(num) OVER w - num) / (sum(den) OVER w - den) AS leave FROM s WINDOW w AS (PARTITION BY system)),
j AS (SELECT system, any_value(estimate) AS estimate, count(*) AS clusters, sqrt((count(*) - 1) * var_pop(leave)) AS error FROM l GROUP BY 1)"""


@query(f"WITH {JACK} SELECT * FROM j")
def jackknife(spark, sf):
    return I.jackknife(sums(spark, sf, "system"), ["system"])


@query(f"WITH {T}, {JACK} SELECT j.*, estimate - q * error AS low, estimate + q * error AS high FROM j JOIN t ON t.df = clusters - 1")
def jackknife_intervals(spark, sf):
    """Student's t interval of each system; the quantiles are numbers in the SQL, for up to 120 clusters."""
    return I.interval(I.jackknife(sums(spark, sf, "system"), ["system"]))


@query(f"""WITH {SUMS}, p AS (SELECT a.cluster, a.num AS an, a.den AS ad, b.num AS bn, b.den AS bd FROM s a JOIN s b ON a.cluster = b.cluster AND a.system = 'A' AND b.system = 'R'),
l AS (SELECT sum(bn) OVER () / sum(bd) OVER () - sum(an) OVER () / sum(ad) OVER () AS delta, (sum(bn) OVER () - bn) / (sum(bd) OVER () - bd) - (sum(an) OVER () - an) / (sum(ad) OVER () - ad) AS leave FROM p)
SELECT any_value(delta) AS delta, count(*) AS clusters, sqrt((count(*) - 1) * var_pop(leave)) AS error FROM l""")
def paired_delta(spark, sf):
    """Difference of two systems over their common clusters; one row a cluster goes into the single window."""
    s = sums(spark, sf, "system")
    a = I.leave_one_out(s.filter("system = 'A'").join(s.filter("system = 'R'").select("cluster"), "cluster", "left_semi"), ["system"]).select("cluster", F.col("estimate").alias("ea"), F.col("leave").alias("la"))
    b = I.leave_one_out(s.filter("system = 'R'").join(s.filter("system = 'A'").select("cluster"), "cluster", "left_semi"), ["system"]).select("cluster", F.col("estimate").alias("eb"), F.col("leave").alias("lb"))
    return a.join(b, "cluster").agg(F.first(F.col("eb") - F.col("ea")).alias("delta"), F.count("*").alias("clusters"), F.sqrt((F.count("*") - 1) * F.var_pop(F.col("lb") - F.col("la"))).alias("error"))


@query("""WITH s AS (SELECT l_returnflag AS system, l_linestatus AS stratum, l_suppkey AS cluster, sum(l_discount * l_quantity) AS num, sum(l_quantity) AS den FROM lineitem GROUP BY 1, 2, 3),
l AS (SELECT system, stratum, sum(num) OVER w / sum(den) OVER w AS estimate, (sum(num) OVER w - num) / nullif(sum(den) OVER w - den, 0) AS leave FROM s WINDOW w AS (PARTITION BY system, stratum))
SELECT system, stratum, any_value(estimate) AS estimate, count(*) AS clusters, CASE WHEN count(leave) > 1 THEN sqrt((count(leave) - 1) * var_pop(leave)) END AS error FROM l GROUP BY 1, 2""")
def strata_report(spark, sf):
    return I.jackknife(sums(spark, sf, "system", "stratum"), ["system", "stratum"])


@query(f"""WITH {SUMS.replace('AS system', 'AS g')}, {drawn_sql(200)}, e AS (SELECT g, sum(num) / sum(den) AS estimate FROM s GROUP BY 1)
SELECT g AS system, round(any_value(e.estimate), 9) AS estimate, round(quantile_cont(d.estimate, 0.025), 8) AS low, round(quantile_cont(d.estimate, 0.975), 8) AS high FROM d JOIN e USING (g) GROUP BY 1""")
def bootstrap(spark, sf):
    """Percentile intervals of ratios over resampled clusters, 200 replicates a system."""
    s = cut(sums(spark, sf, "system"))
    whole = s.groupBy("system").agg((F.sum("num") / F.sum("den")).alias("estimate"))
    out = I.percentile_interval(I.bootstrap(s, ["system"], "cluster", 200), ["system"]).join(whole, "system")
    return out.select("system", *(F.round(c, n).alias(c) for c, n in (("estimate", 9), ("low", 8), ("high", 8))))


@query("""WITH v AS (SELECT l_returnflag AS system, count(DISTINCT l_linestatus) AS identities, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS names FROM lineitem GROUP BY 1)
SELECT system, CASE WHEN identities = 1 THEN names ELSE 'mixed:' || names END AS identity FROM v""")
def scorer_identity(spark, sf):
    """One identity or a note that several met."""
    v = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("system")).agg(F.sort_array(F.collect_set("l_linestatus")).alias("v"))
    names = F.array_join("v", ",")
    return v.select("system", F.when(F.size("v") == 1, names).otherwise(F.concat(F.lit("mixed:"), names)).alias("identity"))
