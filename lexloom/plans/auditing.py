"""Audits: leakage, overlaps, unions, islands, bounds, rates over steps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.expr import split_of
from lexloom.operators import ranges
from lexloom.plans.curation import SPLIT
from lexloom.operators.quantiles import with_quantiles
from lexloom.plans.registry import query, table

SPAN = "e AS (SELECT user_id, event_id, epoch(ts) AS s, epoch(ts) + 3600 * floor(value) AS e FROM events WHERE floor(value) > 0)"


def spans(spark, sf):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").filter("floor(value) > 0").select("user_id", "event_id", start.alias("s"), (start + 3600 * F.floor("value")).alias("e"))


@query(f"SELECT source, count(DISTINCT {SPLIT}) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT {SPLIT}) > 1")
def split_leakage(spark, sf):
    d = table(spark, sf, "documents").select("source", split_of(F.col("doc_id")).alias("split"))
    return d.groupBy("source").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


@query(f"WITH {SPAN} SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e")
def interval_overlap(spark, sf):
    return ranges.overlaps(spans(spark, sf), "user_id", "event_id", "s", "e", 24 * 3600.0)


@query(f"""WITH {SPAN}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e),
i AS (SELECT user_id, s, e, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS k FROM m),
u AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, k)
SELECT user_id, count(*) AS islands, sum(e - s) / (max(e) - min(s)) AS ratio FROM u GROUP BY 1""")
def interval_union_ratio(spark, sf):
    u = ranges.islands(spans(spark, sf).select("user_id", "s", "e"), "user_id", "s", "e")
    return u.groupBy("user_id").agg(F.count("*").alias("islands"), (F.sum(F.col("e") - F.col("s")) / (F.max("e") - F.min("s"))).alias("ratio"))


@query("""WITH f AS (SELECT user_id, ts, event_id, value > 5 AS loud FROM events),
c AS (SELECT *, CASE WHEN loud IS DISTINCT FROM lag(loud) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS n FROM f),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, run::BIGINT AS run, bool_and(loud) AS loud, count(*) AS frames FROM r GROUP BY user_id, run""")
def gaps_islands(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("value") > 5).alias("loud"))
    f = f.withColumn("n", F.when(F.col("loud").eqNullSafe(F.lag("loud").over(w)), 0).otherwise(1))
    f = f.withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return f.groupBy("user_id", "run").agg(F.bool_and("loud").alias("loud"), F.count("*").alias("frames"))


@query("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM conversations GROUP BY 1")
def group_bounds(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, length(text) + max(length(text)) OVER (PARTITION BY conv_id) AS cost FROM conversations")
def group_max_cost(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") + F.max(F.length("text")).over(Window.partitionBy("conv_id"))).cast("long").alias("cost"))


@query("""WITH d AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, quantile_cont(gap, 0.5) AS median_gap, count(gap) AS n FROM d GROUP BY 1""")
def lag_rate_median(spark, sf):
    """Median seconds from one update to the next, over all of them."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf, "events").select("user_id", (t - F.lag(t).over(w)).alias("gap"))
    return with_quantiles(d.groupBy("user_id").agg(F.count("gap").alias("n")), d, "user_id", "gap", {"median_gap": 0.5})


@query("SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def top_groups(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).orderBy(F.desc("n"), "user_id").limit(20)


@query("SELECT event_id FROM events WHERE value IS NULL OR NOT isfinite(value) OR value <= 0 OR ts IS NULL")
def invalid_rows(spark, sf):
    return table(spark, sf, "events").filter(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")) | (F.col("value") <= 0) | F.col("ts").isNull()).select("event_id")
