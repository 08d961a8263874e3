"""Rates, quantiles, grids, channel statistics, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators.quantiles import exact_quantiles, with_quantiles
from lexloom.plans.registry import query, table


@query("SELECT l_returnflag AS system, sum(l_discount * l_quantity) / sum(l_quantity) AS corpus_rate, avg(l_discount) AS mean_rate, avg((l_discount > 0.05)::INT) AS bad_share, count(*) AS n FROM lineitem GROUP BY 1")
def corpus_vs_mean_rate(spark, sf):
    d, q = F.col("l_discount"), F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("system")).agg((F.sum(d * q) / F.sum(q)).alias("corpus_rate"), F.avg(d).alias("mean_rate"), F.avg((d > 0.05).cast("int")).alias("bad_share"), F.count("*").alias("n"))


@query("SELECT avg(quality) AS mean, count(quality) AS rows_with, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def partial_mean(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.agg(F.avg("quality").alias("mean"), F.count("quality").alias("rows_with"), F.count("*").alias("n"))


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS p5, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_extendedprice, 0.95) AS p95, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1")
def quantile_profile(spark, sf):
    """Quantiles and mean of each group, by ranks: a group's values meet in no buffer."""
    q = exact_quantiles(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", (0.05, 0.25, 0.5, 0.75, 0.95))
    return q.select("l_returnflag", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))), "mean")


@query("""SELECT c::DOUBLE AS c, d::DOUBLE AS d, sum(CASE WHEN l_discount <= c AND l_tax <= d THEN l_quantity ELSE 0 END) AS kept, sum(CASE WHEN l_discount <= c AND l_tax <= d THEN l_quantity ELSE 0 END) / sum(l_quantity) AS share,
count(DISTINCT CASE WHEN l_discount <= c AND l_tax <= d THEN l_suppkey END) AS suppliers FROM lineitem, (VALUES (0.02), (0.04), (0.06), (0.08), (0.1)) a(c), (VALUES (0.0), (0.02), (0.04), (0.06), (0.08)) b(d) GROUP BY 1, 2""")
def threshold_grid(spark, sf):
    """25 pairs of thresholds at once: rows first shrink to (both scores, supplier), then meet the constant grid."""
    grid = [(c, d) for c in (0.02, 0.04, 0.06, 0.08, 0.1) for d in (0.0, 0.02, 0.04, 0.06, 0.08)]
    small = table(spark, sf, "lineitem").groupBy("l_discount", "l_tax", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    each = small.withColumn("g", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(d).alias("d")) for c, d in grid)))).select("l_discount", "l_tax", "l_suppkey", "q", "g.c", "g.d")
    ok = (F.col("l_discount") <= F.col("c")) & (F.col("l_tax") <= F.col("d"))
    kept = F.sum(F.when(ok, F.col("q")).otherwise(0))
    return each.groupBy("c", "d").agg(kept.alias("kept"), (kept / F.sum("q")).alias("share"), F.count_distinct(F.when(ok, F.col("l_suppkey"))).alias("suppliers"))


@query("SELECT source, sum(n_chars)::BIGINT AS chars, quantile_cont(n_chars::DOUBLE, 0.5) AS median FROM documents GROUP BY 1 ORDER BY chars DESC, source LIMIT 30")
def program_medians(spark, sf):
    d = table(spark, sf, "documents")
    return with_quantiles(d.groupBy("source").agg(F.sum("n_chars").alias("chars")), d, "source", "n_chars", {"median": 0.5}).orderBy(F.desc("chars"), "source").limit(30)


MOMENTS = "x AS (SELECT generate_subscripts(embedding, 1) - 1 AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(f"WITH {MOMENTS} SELECT channel, count(*) AS n, avg(v) AS mean, sqrt(greatest(var_pop(v), 1e-6)) AS std FROM x GROUP BY 1")
def channel_stats(spark, sf):
    x = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("channel", "v")).select(F.col("channel").cast("long").alias("channel"), F.col("v").cast("double").alias("v"))
    return x.groupBy("channel").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.sqrt(F.greatest(F.var_pop("v"), F.lit(1e-6))).alias("std"))


@query(f"WITH {MOMENTS}, m AS (SELECT channel, avg(v) AS m FROM x GROUP BY 1) SELECT channel, round(avg((v - m) ** 4) / avg((v - m) ** 2) ** 2 - 3, 6) AS kurtosis, round(avg((v - m) ** 3) / avg((v - m) ** 2) ** 1.5, 6) AS skew FROM x JOIN m USING (channel) GROUP BY 1")
def channel_moments(spark, sf):
    x = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("channel", "v")).select(F.col("channel").cast("long").alias("channel"), F.col("v").cast("double").alias("v"))
    return x.groupBy("channel").agg(F.round(F.kurtosis("v"), 6).alias("kurtosis"), F.round(F.skewness("v"), 6).alias("skew"))


@query(f"WITH {MOMENTS} SELECT channel, quantile_disc(v, 0.5) AS median FROM x GROUP BY 1")
def median_array(spark, sf):
    x = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("channel", "v"))
    return x.groupBy(F.col("channel").cast("long").alias("channel")).agg(F.expr("percentile_disc(0.5) within group (order by cast(v as double))").alias("median"))


@query("SELECT (r - 1) // 50 AS chunk, avg(value) AS mean FROM (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY 1")
def chunk_means(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("value", F.row_number().over(w).alias("r")).groupBy(F.expr("cast((r - 1) div 50 as bigint)").alias("chunk")).agg(F.avg("value").alias("mean"))


KINDS = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"avg(value) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS) + ", max_by(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def leaderboard_pivot(spark, sf):
    """Each system's mean of every measure and its last value."""
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))
    wide = e.groupBy("user_id").pivot("event_type", list(KINDS)).agg(F.avg("value"))
    return last.join(wide, "user_id")


@query("""WITH d AS (SELECT event_type, user_id % 3 AS seed, datediff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // 7 AS step, value FROM events), s AS (SELECT event_type, step, seed, avg(value) AS v FROM d GROUP BY ALL), p AS (SELECT event_type, step, avg(v) AS v, count(*) AS seeds FROM s GROUP BY ALL)
SELECT event_type, """ + ", ".join(f"avg(v) FILTER (WHERE step = {k}) AS step_{k}" for k in range(5)) + ", max_by(v, step) FILTER (WHERE seeds = 3) AS last_full FROM p GROUP BY 1")
def trajectory_pivot(spark, sf):
    """Each system's course over the steps, seeds pooled, and its value at the last step that all seeds reached."""
    e = table(spark, sf, "events")
    start = F.broadcast(e.agg(F.min(F.to_date("ts")).alias("start")))
    d = e.crossJoin(start).select("event_type", (F.col("user_id") % 3).alias("seed"), F.floor(F.datediff(F.to_date("ts"), F.col("start")) / 7).alias("step"), "value")
    p = d.groupBy("event_type", "step", "seed").agg(F.avg("value").alias("v")).groupBy("event_type", "step").agg(F.avg("v").alias("v"), F.count("*").alias("seeds"))
    full = F.max_by(F.when(F.col("seeds") == 3, F.col("v")), F.when(F.col("seeds") == 3, F.col("step")))
    return p.groupBy("event_type").agg(*(F.avg(F.when(F.col("step") == k, F.col("v"))).alias(f"step_{k}") for k in range(5)), full.alias("last_full"))


@query("SELECT l_returnflag, l_linestatus, sum(l_discount * l_quantity) / sum(l_quantity) AS rate FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))")
def grouped_rates(spark, sf):
    sets = table(spark, sf, "lineitem").groupingSets([[], ["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus")
    return sets.agg((F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("rate"))


@query("""WITH a AS (SELECT l_tax AS factor, avg(l_discount) AS score FROM lineitem WHERE l_tax > 0 GROUP BY 1) SELECT factor, score FROM a ORDER BY round(score, 9), abs(ln(factor)), factor LIMIT 1""")
def best_factor(spark, sf):
    a = table(spark, sf, "lineitem").filter("l_tax > 0").groupBy(F.col("l_tax").alias("factor")).agg(F.avg("l_discount").alias("score"))
    return a.orderBy(F.round("score", 9), F.abs(F.ln("factor")), "factor").limit(1)


@query("""WITH f AS (SELECT source, ln(n_chars + 1) AS y, length(text) - length(replace(text, ' ', '')) AS w FROM documents)
SELECT count(*) AS n, sum(w::DOUBLE * w) AS xx, sum(w)::DOUBLE AS x, sum(w * y) AS xy, sum(y) AS y FROM f""")
def ridge_normal_equations(spark, sf):
    f = table(spark, sf, "documents").select(F.ln(F.col("n_chars") + 1).alias("y"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("w"))
    return f.agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("w")).alias("xx"), F.sum("w").alias("x"), F.sum(F.col("w") * F.col("y")).alias("xy"), F.sum("y").alias("y"))


YIELD = """s AS (SELECT d.doc_id, d.source, d.n_chars / 36000.0::DOUBLE AS hours, l.quality, (d.doc_id * 7 % 10) / 10.0::DOUBLE AS error FROM documents d LEFT JOIN labels l USING (doc_id)),
g AS (SELECT * FROM (VALUES (0), (1)) a(least), (VALUES (0.2), (0.5), (0.9)) b(most))"""


@query(f"""WITH {YIELD}, k AS (SELECT source, count(*) AS clips, sum(hours) AS hours, quantile_cont(hours, 0.5) AS median FROM s GROUP BY 1)
SELECT 'grid' AS part, least || '/' || most::DOUBLE AS name, round(coalesce(sum(hours) FILTER (WHERE quality >= least AND error <= most), 0), 6) AS hours, round(coalesce(sum(hours) FILTER (WHERE quality >= least AND error <= most), 0) / sum(hours), 6) AS share,
count(DISTINCT CASE WHEN quality >= least AND error <= most THEN source END) AS speakers, NULL::DOUBLE AS median FROM s, g GROUP BY least, most
UNION ALL SELECT 'unscored', 'all', round(coalesce(sum(hours) FILTER (WHERE quality IS NULL), 0), 6), round(coalesce(sum(hours) FILTER (WHERE quality IS NULL), 0) / sum(hours), 6), count(DISTINCT CASE WHEN quality IS NULL THEN source END), NULL FROM s
UNION ALL (SELECT 'program', source, round(hours, 6), round(hours / (SELECT sum(hours) FROM s), 6), clips, round(median, 9) FROM k ORDER BY k.hours DESC, source LIMIT 30)""")
def filter_yield(spark, sf):
    """One report of what thresholds keep: samples with their scores, hours, share and speakers for each pair of thresholds, what has no score, and the largest programs with their medians."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    s = d.select("source", (F.col("n_chars") / 36000.0).alias("hours"), "quality", (F.col("doc_id") * 7 % 10 / 10.0).alias("error"))
    small = s.groupBy("source", "quality", "error").agg(F.sum("hours").alias("hours"))
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("least"), F.lit(b).alias("most")) for a in (0, 1) for b in (0.2, 0.5, 0.9))))
    each = small.withColumn("g", grid).select("source", "quality", "hours", "error", "g.least", "g.most")

    def kept(ok):
        hours = F.coalesce(F.sum(F.when(ok, F.col("hours"))), F.lit(0.0))
        return F.round(hours, 6).alias("hours"), F.round(hours / F.sum("hours"), 6).alias("share"), F.count_distinct(F.when(ok, F.col("source"))).alias("speakers"), F.lit(None).cast("double").alias("median")

    cells = each.groupBy("least", "most").agg(*kept((F.col("quality") >= F.col("least")) & (F.col("error") <= F.col("most"))))
    cells = cells.select(F.lit("grid").alias("part"), F.concat_ws("/", F.col("least").cast("string"), F.col("most").cast("string")).alias("name"), "hours", "share", "speakers", "median")
    none = small.agg(*kept(F.col("quality").isNull())).select(F.lit("unscored").alias("part"), F.lit("all").alias("name"), "hours", "share", "speakers", "median")
    programs = with_quantiles(s.groupBy("source").agg(F.count("*").alias("clips"), F.sum("hours").alias("hours")), s, "source", "hours", {"median": 0.5}).orderBy(F.desc("hours"), "source").limit(30)
    total = F.broadcast(s.agg(F.sum("hours").alias("total")))  # one row
    programs = programs.join(total).select(F.lit("program").alias("part"), F.col("source").alias("name"), F.round("hours", 6).alias("hours"), F.round(F.col("hours") / F.col("total"), 6).alias("share"), F.col("clips").alias("speakers"), F.round("median", 9).alias("median"))
    return cells.unionByName(none).unionByName(programs)
