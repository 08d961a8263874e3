"""Reports: failure shares, moments, thresholds by program, speed bands, arms, second judges, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.expr import ascii_metric_text, word_distance, words
from lexloom.operators.quantiles import exact_quantiles, with_quantiles
from lexloom.plans.curation import KEY
from lexloom.plans.registry import query, table


def share(c):
    return F.avg(c.cast("double"))


@query("""SELECT l_shipmode, avg((l_discount > 0.05)::INT)::DOUBLE AS over_half, avg((l_discount = 0)::INT)::DOUBLE AS error_free, avg((l_tax > 0.07)::INT)::DOUBLE AS hallucinated, avg((l_returnflag = 'R')::INT)::DOUBLE AS failed
FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def failure_shares(spark, sf):
    """Shares of rows over a limit, without error, flagged and failed."""
    x = table(spark, sf, "lineitem").withColumn("l_shipmode", F.col("l_linestatus"))
    return x.groupBy("l_shipmode").agg(share(F.col("l_discount") > 0.05).alias("over_half"), share(F.col("l_discount") == 0).alias("error_free"), share(F.col("l_tax") > 0.07).alias("hallucinated"), share(F.col("l_returnflag") == "R").alias("failed"))


CHANNEL = "x AS (SELECT vec_id, label, vec_id % 2 = 0 AS made, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))"


@query(f"""WITH {CHANNEL}, m AS (SELECT label, i, made, avg(v) AS mean, stddev_pop(v) AS std, kurtosis_pop(v) AS kurt, avg(v * v) AS sq FROM x GROUP BY ALL),
p AS (SELECT g.label, g.i, g.std / greatest(r.std, 1e-6) AS ratio, abs(g.mean - r.mean) / greatest(r.std, 1e-6) AS shift, g.kurt AS gk, r.kurt AS rk, g.sq AS gs, r.sq AS rs FROM m g JOIN m r ON g.label = r.label AND g.i = r.i AND g.made AND NOT r.made)
SELECT label, avg(ratio) AS std_ratio_mean, min(ratio) AS std_ratio_min, max(ratio) AS std_ratio_max, sqrt(avg(gs)) / greatest(sqrt(avg(rs)), 1e-12) AS rms_ratio, avg(shift) AS mean_shift, avg(gk) AS kurtosis_generated, avg(rk) AS kurtosis_reference FROM p GROUP BY 1""")
def moment_ratios(spark, sf):
    """Channel moments of generated rows against reference rows, and their ratios' summary."""
    p = _moments(spark, sf)
    return p.groupBy("label").agg(
        F.avg("ratio").alias("std_ratio_mean"), F.min("ratio").alias("std_ratio_min"), F.max("ratio").alias("std_ratio_max"),
        (F.sqrt(F.avg("g_sq")) / F.greatest(F.sqrt(F.avg("r_sq")), F.lit(1e-12))).alias("rms_ratio"), F.avg("shift").alias("mean_shift"),
        F.avg("g_kurt").alias("kurtosis_generated"), F.avg("r_kurt").alias("kurtosis_reference"),
    )


def _moments(spark, sf):
    """label, i and the moments of both sides: one aggregation, the sides in columns, no join."""
    x = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 2 == 0).alias("made"), F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    g, r = (F.when(F.col("made") == side, F.col("v")) for side in (True, False))
    aggs = [f(c * c if n == "sq" else c).alias(f"{s}_{n}") for s, c in (("g", g), ("r", r)) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("kurt", F.kurtosis), ("sq", F.avg))]
    m = x.groupBy("label", "i").agg(*aggs).filter("g_mean is not null and r_mean is not null")
    floor = F.greatest(F.col("r_std"), F.lit(1e-6))
    return m.withColumn("ratio", F.col("g_std") / floor).withColumn("shift", F.abs(F.col("g_mean") - F.col("r_mean")) / floor)


@query(f"""WITH {CHANNEL}, m AS (SELECT label, i, made, avg(v) AS mean, stddev_pop(v) AS std FROM x GROUP BY ALL)
SELECT x.vec_id, x.i::INT AS i, (x.v - g.mean) * least(greatest(r.std / greatest(g.std, 1e-6), 0.5), 2.0) + g.mean AS matched FROM x JOIN m g ON g.label = x.label AND g.i = x.i AND g.made JOIN m r ON r.label = x.label AND r.i = x.i AND NOT r.made WHERE x.made""")
def matched_moments(spark, sf):
    """Generated channels brought to the reference's spread around their own means, by factors between 0.5 and 2."""
    m = _moments(spark, sf).select("label", (F.col("i") + 1).alias("i"), "g_mean", F.least(F.greatest(F.col("r_std") / F.greatest(F.col("g_std"), F.lit(1e-6)), F.lit(0.5)), F.lit(2.0)).alias("factor"))
    x = table(spark, sf, "embeddings").filter("vec_id % 2 = 0").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("i", F.col("i") + 1)
    return x.join(m, ["label", "i"]).select("vec_id", "i", ((F.col("v").cast("double") - F.col("g_mean")) * F.col("factor") + F.col("g_mean")).alias("matched"))


@query("""WITH x AS (SELECT vec_id % 5 AS part, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i) WHERE vec_id % 10 <> 0)
SELECT i::INT AS channel, count(*) AS n, sum(v) / count(*) AS mean, greatest(sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) ** 2, 0)), 1e-6) AS std FROM x GROUP BY 1""")
def train_channel_stats(spark, sf):
    """Count, mean and deviation (at least 1e-6) of each channel over train rows, from sums that partitions can add up."""
    x = table(spark, sf, "embeddings").filter("vec_id % 10 <> 0").select(F.posexplode("embedding").alias("channel", "v")).withColumn("v", F.col("v").cast("double"))
    s = x.groupBy((F.col("channel") + 1).alias("channel")).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    mean = F.col("s") / F.col("n")
    return s.select("channel", "n", mean.alias("mean"), F.greatest(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(1e-6)).alias("std"))


@query("""WITH p AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), q AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS n, list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL)) AS licenses FROM (SELECT * FROM p UNION ALL SELECT * FROM q) GROUP BY 1""")
def merged_source_summary(spark, sf):
    """Summaries of two partitions merged: rows add up, distinct licences unite."""
    d = table(spark, sf, "documents")
    parts = [d.filter(F.col("doc_id") % 2 == k).groupBy("source").agg(F.count("*").alias("n"), F.collect_set("lang").alias("licenses")) for k in (0, 1)]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("source").agg(F.sum("n").alias("n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("licenses")))).alias("licenses"))


@query("""WITH s AS (SELECT source, count(*) AS clips FROM documents GROUP BY 1)
SELECT count(*) AS speakers, count(*) FILTER (WHERE clips >= 2) AS with_two, quantile_cont(clips, [0.1, 0.5, 0.9]) AS clips FROM s""")
def speaker_counts(spark, sf):
    """Speakers, those with two clips and more, quantiles of clips by speaker."""
    s = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("clips"))
    q = exact_quantiles(s, (), "clips", (0.1, 0.5, 0.9)).select(F.col("q").alias("clips"))
    return s.agg(F.count("*").alias("speakers"), F.count(F.when(F.col("clips") >= 2, 1)).alias("with_two")).join(F.broadcast(q), how="left")  # one row each


@query("""WITH m AS (SELECT user_id, count(*) / 3600.0 AS hours, median(value) AS median FROM events GROUP BY 1)
SELECT sum(hours)::DOUBLE AS hours, coalesce(sum(hours) FILTER (WHERE median > 50), 0)::DOUBLE AS bad_hours, count(*) FILTER (WHERE median > 50) AS bad_programs FROM m""")
def bad_median_hours(spark, sf):
    """Hours of programs whose median is beyond a limit."""
    e = table(spark, sf, "events")
    m = with_quantiles(e.groupBy("user_id").agg((F.count("*") / 3600.0).alias("hours")), e, "user_id", "value", {"median": 0.5})
    bad = F.when(F.col("median") > 50, F.col("hours"))
    return m.agg(F.sum("hours").cast("double").alias("hours"), F.coalesce(F.sum(bad), F.lit(0.0)).cast("double").alias("bad_hours"), F.count(bad).alias("bad_programs"))


@query("SELECT label, avg(c) AS mean_clipped, max(c) AS max_clipped, avg((c > 0)::INT)::DOUBLE AS clipping_share FROM (SELECT label, list_avg(list_transform(embedding, lambda x: (abs(x::DOUBLE) >= 0.25)::INT))::DOUBLE AS c FROM embeddings) GROUP BY 1")
def clipping(spark, sf):
    """Share of clipped samples: mean and most by group, and how many files clip."""
    clipped = F.size(F.filter("embedding", lambda x: F.abs(x.cast("double")) >= 0.25)) / F.size("embedding")
    v = table(spark, sf, "embeddings").select("label", clipped.alias("c"))
    return v.groupBy("label").agg(F.avg("c").alias("mean_clipped"), F.max("c").alias("max_clipped"), share(F.col("c") > 0).alias("clipping_share"))


@query("""WITH e AS (SELECT CASE WHEN l_quantity < 15 THEN 'slow' WHEN l_quantity <= 35 THEN 'normal' ELSE 'fast' END AS band, ln(l_extendedprice / (l_quantity * 1500)) AS err FROM lineitem)
SELECT band, count(*) AS n, avg(abs(err)) AS mae, avg(err) AS bias, median(abs(exp(err) - 1)) AS median_relative, avg((abs(exp(err) - 1) <= 0.1)::INT)::DOUBLE AS within_10, avg((abs(exp(err) - 1) <= 0.2)::INT)::DOUBLE AS within_20 FROM e GROUP BY 1""")
def log_error_report(spark, sf):
    """Errors of a prediction on the log scale, by rate band."""
    band = F.when(F.col("l_quantity") < 15, "slow").when(F.col("l_quantity") <= 35, "normal").otherwise("fast")
    e = table(spark, sf, "lineitem").select(band.alias("band"), F.ln(F.col("l_extendedprice") / (F.col("l_quantity") * 1500)).alias("err"))
    off = F.abs(F.exp("err") - 1)
    means = e.groupBy("band").agg(F.count("*").alias("n"), F.avg(F.abs("err")).alias("mae"), F.avg("err").alias("bias"), share(off <= 0.1).alias("within_10"), share(off <= 0.2).alias("within_20"))
    return with_quantiles(means, e, "band", off, {"median_relative": 0.5})


@query("""WITH t AS (SELECT least(floor(l_discount * 50), 4)::INT AS i, 'time' AS kind, l_tax AS v FROM lineitem UNION ALL
SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 WHEN l_quantity <= 40 THEN 2 ELSE 3 END, 'length', l_tax FROM lineitem) SELECT kind, i::INT AS bin, round(sum(v), 6) AS total, count(*) AS n FROM t GROUP BY ALL""")
def loss_buckets(spark, sf):
    """Sum and count of a loss in five time bins and four length bins: both sets from one scan."""
    time = F.least(F.floor(F.col("l_discount") * 50), F.lit(4)).cast("int")
    length = F.when(F.col("l_quantity") <= 10, 0).when(F.col("l_quantity") <= 25, 1).when(F.col("l_quantity") <= 40, 2).otherwise(3)
    x = table(spark, sf, "lineitem").select(F.explode(F.array(F.struct(F.lit("time").alias("kind"), time.alias("bin")), F.struct(F.lit("length").alias("kind"), length.alias("bin")))).alias("b"), "l_tax")
    return x.groupBy("b.kind", "b.bin").agg(F.round(F.sum("l_tax"), 6).alias("total"), F.count("*").alias("n"))


@query("""WITH f AS (SELECT user_id, CASE WHEN value < 30 THEN 0.9 WHEN value < 60 THEN 1.0 ELSE 1.1 END::DOUBLE AS factor, CASE WHEN event_id % 3 = 0 THEN 'slow' WHEN event_id % 3 = 1 THEN 'normal' ELSE 'fast' END AS band FROM events)
SELECT band, count(*) AS n, avg(factor) AS mean_factor, count(*) FILTER (WHERE factor = 0.9) AS n_900, count(*) FILTER (WHERE factor = 1.0) AS n_1000, count(*) FILTER (WHERE factor = 1.1) AS n_1100, avg((factor <> 1.0)::INT)::DOUBLE AS changed FROM f GROUP BY 1""")
def refit_report(spark, sf):
    """Chosen factors by speed band: mean, histogram, share that changed."""
    factor = F.when(F.col("value") < 30, 0.9).when(F.col("value") < 60, 1.0).otherwise(1.1)
    band = F.element_at(F.array(F.lit("slow"), F.lit("normal"), F.lit("fast")), (F.col("event_id") % 3 + 1).cast("int"))
    f = table(spark, sf, "events").select(band.alias("band"), factor.alias("factor"))
    counts = [F.count(F.when(F.col("factor") == v, 1)).alias(f"n_{round(v * 1000)}") for v in (0.9, 1.0, 1.1)]
    return f.groupBy("band").agg(F.count("*").alias("n"), F.avg("factor").alias("mean_factor"), *counts, share(F.col("factor") != 1.0).alias("changed"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[!-&(-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS wer_text FROM documents")
def deleted_punctuation(spark, sf):
    """Error-rate text that deletes ASCII punctuation but keeps the apostrophe."""
    low = F.regexp_replace(F.lower("text"), r"[!-&(-/:-@\[-`{-~]", "")
    return table(spark, sf, "documents").select("doc_id", F.trim(F.regexp_replace(low, r"\s+", " ")).alias("wer_text"))


@query("""WITH c AS (SELECT event_type, list_sort(list(f || ':' || n)) AS factors FROM (SELECT event_type, user_id % 3 AS f, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)
SELECT event_type, avg((value > 90)::INT)::DOUBLE AS clipping_share, median(value) AS median_level, count(*) FILTER (WHERE event_id % 7 = 0) AS selection_changed, any_value(factors) AS factors FROM events JOIN c USING (event_type) GROUP BY event_type""")
def evaluation_summary(spark, sf):
    """Share of clipping files, median level, how often a selection changed, counts of each factor."""
    e = table(spark, sf, "events")
    one = e.groupBy("event_type").agg(share(F.col("value") > 90).alias("clipping_share"), F.count(F.when(F.col("event_id") % 7 == 0, 1)).alias("selection_changed"))
    one = with_quantiles(one, e, "event_type", "value", {"median_level": 0.5})
    f = e.groupBy("event_type", (F.col("user_id") % 3).alias("f")).agg(F.count("*").alias("n")).groupBy("event_type").agg(F.sort_array(F.collect_list(F.concat_ws(":", "f", "n"))).alias("factors"))  # three factors
    return one.join(f, "event_type")


@query("SELECT event_type, count(*) FILTER (WHERE starts_with(props, '{\"k\": 1')) AS score_errors FROM events GROUP BY 1")
def score_errors(spark, sf):
    """Rows whose error starts with a given word."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.when(F.startswith("props", F.lit('{"k": 1')), 1)).alias("score_errors"))


@query(f"""WITH n AS (SELECT conv_id, turn, role, text AS r, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations),
k AS (SELECT role, {KEY.format('r')} AS r, {KEY.format('h')} AS h FROM n WHERE h IS NOT NULL) SELECT role, count(*) AS n, sum(levenshtein(replace(r, ' ', ''), replace(h, ' ', '')))::BIGINT AS char_edits, sum(length(replace(r, ' ', '')))::BIGINT AS chars,
sum(levenshtein(replace(r, ' ', ''), replace(h, ' ', '')))::DOUBLE / sum(length(replace(r, ' ', ''))) AS cer FROM k GROUP BY 1""")
def second_judge(spark, sf):
    """The same rows scored again with another transcript: corpus rates."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("role", "text", F.lead("text").over(w).alias("h")).filter("h is not null")
    bare = lambda name: F.replace(ascii_metric_text(F.col(name)), F.lit(" "), F.lit(""))
    c = c.select("role", bare("text").alias("r"), bare("h").alias("h")).select("role", F.levenshtein("r", "h").cast("long").alias("e"), F.length("r").cast("long").alias("c"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum("e").alias("char_edits"), F.sum("c").alias("chars"), (F.sum("e") / F.sum("c")).alias("cer"))


@query("""WITH s AS (SELECT event_type, ts, value, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events)
SELECT event_type, arg_max(value, ts) AS last_value, median(gap) AS seconds_per_update, avg(value) AS mean_frames FROM s GROUP BY 1""")
def arm_table(spark, sf):
    """Last validation value, median seconds an update, mean frames of each arm."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    s = table(spark, sf, "events").withColumn("t", at).withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("event_type").orderBy("ts", "event_id")))
    return with_quantiles(s.groupBy("event_type").agg(F.max_by("value", "ts").alias("last_value"), F.avg("value").alias("mean_frames")), s, "event_type", "gap", {"seconds_per_update": 0.5})


@query("""WITH p AS (SELECT source, min(doc_id) AS prompt FROM documents GROUP BY 1), x AS (SELECT doc_id FROM labels WHERE toxic = 1),
r AS (SELECT d.source, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS k FROM documents d JOIN p ON p.source = d.source AND p.prompt <> d.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM x)) SELECT source, doc_id, k FROM r WHERE k <= 3""")
def ceiling_sample(spark, sf):
    """The first three other clips of each prompt's speaker, without excluded ones."""
    d = table(spark, sf, "documents").select("source", "doc_id")
    prompt = d.groupBy("source").agg(F.min("doc_id").alias("prompt"))
    rest = d.join(prompt, "source").filter("doc_id != prompt").join(table(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return rest.withColumn("k", k).filter("k <= 3").select("source", "doc_id", F.col("k").cast("long").alias("k"))


@query("""SELECT l_returnflag, round(sum(l_tax * l_quantity), 4) / sum(l_quantity) AS delta, round(sum(l_discount), 6) / greatest(count(*) FILTER (WHERE l_discount > 0), 1e-12) AS negative_random, count(*) FILTER (WHERE l_discount > 0)::DOUBLE / count(*) AS random_coverage FROM lineitem GROUP BY 1""")
def contrastive_statistics(spark, sf):
    """Loss sums as ratios: a weighted mean, a mean over the rows that had a negative, and their share."""
    had = F.count(F.when(F.col("l_discount") > 0, 1))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        (F.round(F.sum(F.col("l_tax") * F.col("l_quantity")), 4) / F.sum("l_quantity")).alias("delta"),
        (F.round(F.sum("l_discount"), 6) / F.greatest(had.cast("double"), F.lit(1e-12))).alias("negative_random"), (had.cast("double") / F.count("*")).alias("random_coverage"),
    )


@query("""WITH f AS (SELECT date_trunc('day', ts) AS step, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1), l AS (SELECT max(step) AS step FROM f WHERE kinds = (SELECT count(DISTINCT event_type) FROM events)),
s AS (SELECT event_type, user_id % 4 AS seed, avg(value) AS v FROM events, l WHERE date_trunc('day', ts) = l.step GROUP BY ALL) SELECT event_type, avg(v) AS pooled, count(*) AS seeds FROM s GROUP BY 1""")
def last_full_evaluation(spark, sf):
    """The last step that has every part of the evaluation, seeds pooled as a mean of means."""
    e = table(spark, sf, "events").withColumn("step", F.date_trunc("day", F.col("ts")))
    kinds = F.broadcast(e.agg(F.count_distinct("event_type").alias("all")))
    last = e.groupBy("step").agg(F.count_distinct("event_type").alias("kinds")).crossJoin(kinds).filter("kinds = all").agg(F.max("step").alias("step"))
    s = e.join(F.broadcast(last), "step").groupBy("event_type", (F.col("user_id") % 4).alias("seed")).agg(F.avg("value").alias("v"))
    return s.groupBy("event_type").agg(F.avg("v").alias("pooled"), F.count("*").alias("seeds"))


@query("""WITH r AS (SELECT o_custkey AS g, o_orderkey, o_totalprice AS reward, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), t AS (SELECT *, k % 3 AS term FROM r)
SELECT g, count(*) AS n, arg_min(reward, k) AS first, avg(reward) AS mean, max(reward) AS best, arg_max(term, (reward, -k)) AS best_term, stddev_pop(reward) AS spread FROM t GROUP BY 1""")
def best_of_n_summary(spark, sf):
    """First, mean and best reward of a group, which term the best came by, and the spread."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_totalprice").alias("reward"), k.alias("k")).withColumn("term", (F.col("k") % 3).cast("long"))
    return t.groupBy("g").agg(
        F.count("*").alias("n"), F.min_by("reward", "k").alias("first"), F.avg("reward").alias("mean"), F.max("reward").alias("best"),
        F.max_by("term", F.struct("reward", -F.col("k"))).alias("best_term"), F.stddev_pop("reward").alias("spread"),
    )


@query("""WITH r AS (SELECT l_orderkey AS g, l_linenumber AS k, l_discount AS cer, l_tax AS wer, l_quantity AS mos, l_partkey AS p, l_suppkey AS s FROM lineitem),
x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY cer, wer, k, p, s) AS lexical, row_number() OVER (PARTITION BY g ORDER BY round((mos - 10 * cer) * 1e9) DESC, k, p, s) AS weighted FROM r) SELECT g, k, lexical, weighted FROM x""")
def candidate_ranks(spark, sf):
    """Candidates ranked by measures in order, and by their weighted sum; ties keep the earlier one."""
    from lexloom.functions.specs import parse_selection, ranking

    lex, wei = parse_selection("cer,wer"), parse_selection("cer:10,dnsmos:1")
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), F.col("l_discount").alias("cer"), F.col("l_tax").alias("wer"), F.col("l_quantity").alias("dnsmos"))
    rank = lambda spec: F.row_number().over(Window.partitionBy("g").orderBy(*ranking(spec, "place"))).cast("long")
    return x.select("g", "k", rank(lex).alias("lexical"), rank(wei).alias("weighted"))


@query("""WITH w AS (SELECT o_custkey AS g, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS winner, max(o_totalprice) AS best, min_by(o_orderkey, (o_totalprice, -o_orderkey)) AS loser, min(o_totalprice) AS worst, arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) AS wp, arg_min(o_orderpriority, (o_totalprice, -o_orderkey)) AS lp FROM orders GROUP BY 1)
SELECT g, winner, loser, best - worst AS margin FROM w WHERE winner <> loser AND best - worst >= 50000 AND wp <= lp""")
def gated_pairs(spark, sf):
    """Best and worst of each group, if the margin is wide and the winner is no worse on a second measure; of equal rewards the first wins, the last loses."""
    at = F.struct("o_totalprice", -F.col("o_orderkey"))
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("g")).agg(
        F.max_by("o_orderkey", at).alias("winner"), F.min_by("o_orderkey", at).alias("loser"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("margin"),
        F.max_by("o_orderpriority", at).alias("wp"), F.min_by("o_orderpriority", at).alias("lp"),
    )
    return g.filter("winner <> loser and margin >= 50000 and wp <= lp").select("g", "winner", "loser", "margin")


def error_rates(rows):
    """word_edits, words, char_edits, chars of (r, h), already metric text."""
    rw, hw = words(F.col("r")), words(F.col("h"))
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return rows.select("*", word_distance(rw, hw).alias("word_edits"), F.size(rw).alias("words"), F.levenshtein(bare("r"), bare("h")).alias("char_edits"), F.length(bare("r")).alias("chars"))
