"""Whole comparisons: scorer gate, paired systems with what is unpaired, intervals and verdicts, the promotion gate, coverage of intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.specs import family_of
from lexloom.operators import compare as C
from lexloom.operators import intervals as I
from lexloom.plans.curation import HASH
from lexloom.plans.registry import query, table

#: Student's quantiles at 97.5 % for the degrees of freedom that occur, as rows of the SQL.
T = "t(df, q) AS (VALUES " + ", ".join(f"({d}, {I.t_quantile(0.975, d)!r}::DOUBLE)" for d in range(1, 120)) + ")"
ROWS = """r AS (SELECT event_type AS system, user_id % 60 AS item, user_id % 12 AS cluster, floor(value) AS num, 10 + event_id % 5 AS den, event_id FROM events WHERE NOT (event_type = 'click' AND user_id % 60 = 7) AND NOT (event_type = 'view' AND user_id % 60 < 3)),
i AS (SELECT system, item, cluster, avg(num) AS num, avg(den) AS den FROM r GROUP BY ALL)"""


def items(spark, sf):
    e = table(spark, sf, "events").filter("not (event_type = 'click' and user_id % 60 = 7) and not (event_type = 'view' and user_id % 60 < 3)")
    rows = e.select(F.col("event_type").alias("system"), (F.col("user_id") % 60).alias("item"), (F.col("user_id") % 12).alias("cluster"), F.floor("value").alias("num"), (10 + F.col("event_id") % 5).alias("den"))
    return C.replicates(rows, ["system", "item", "cluster"], ["num", "den"])


PAIRED = f"""{ROWS}, b AS (SELECT * FROM i WHERE system = 'click'), o AS (SELECT * FROM i WHERE system <> 'click'), sys AS (SELECT DISTINCT system FROM o),
u AS (SELECT s.system, count(*) FILTER (WHERE o.item IS NULL) AS only_baseline, count(*) FILTER (WHERE o.item IS NOT NULL) AS pairs FROM sys s JOIN b ON true LEFT JOIN o ON o.system = s.system AND o.item = b.item AND o.cluster = b.cluster GROUP BY 1),
v AS (SELECT o.system, count(*) FILTER (WHERE b.item IS NULL) AS only_system FROM o LEFT JOIN b ON o.item = b.item AND o.cluster = b.cluster GROUP BY 1),
p AS (SELECT o.system, o.cluster, sum(b.num) AS an, sum(b.den) AS ad, sum(o.num) AS bn, sum(o.den) AS bd FROM o JOIN b ON o.item = b.item AND o.cluster = b.cluster GROUP BY 1, 2),
l AS (SELECT system, sum(bn) OVER w / sum(bd) OVER w - sum(an) OVER w / sum(ad) OVER w AS delta, (sum(bn) OVER w - bn) / (sum(bd) OVER w - bd) - (sum(an) OVER w - an) / (sum(ad) OVER w - ad) AS leave FROM p WINDOW w AS (PARTITION BY system)),
j AS (SELECT system, any_value(delta) AS delta, count(*) AS clusters, sqrt((count(*) - 1) * var_pop(leave)) AS error FROM l GROUP BY 1)"""


@query(f"""WITH {T}, {PAIRED} SELECT j.system, round(delta, 9) AS delta, clusters, pairs, only_baseline, coalesce(only_system, 0) AS only_system, round(delta - q * error, 7) AS low, round(delta + q * error, 7) AS high,
CASE WHEN delta - q * error <= 0 AND delta + q * error >= 0 THEN 'tie' WHEN delta - q * error > 0 THEN 'win' ELSE 'loss' END AS verdict FROM j JOIN t ON t.df = clusters - 1 JOIN u USING (system) LEFT JOIN v USING (system)""")
def compare_report(spark, sf):
    """Each system against the baseline over their common items: difference, t interval over clusters, verdict, and what has no partner."""
    out = C.against(items(spark, sf), "system", "click", ["item", "cluster"], "cluster")
    return out.select("system", F.round("delta", 9).alias("delta"), "clusters", "pairs", "only_baseline", "only_system", F.round("low", 7).alias("low"), F.round("high", 7).alias("high"), "verdict")


@query(f"""WITH {T}, s AS (SELECT l_returnflag AS system, l_suppkey % 90 AS cluster, sum(l_discount * l_quantity) AS num, sum(l_quantity) AS den FROM lineitem GROUP BY 1, 2),
l AS (SELECT system, sum(num) OVER w / sum(den) OVER w AS estimate, (sum(num) OVER w - num) / (sum(den) OVER w - den) AS leave FROM s WINDOW w AS (PARTITION BY system)),
j AS (SELECT system, any_value(estimate) AS estimate, count(*) AS clusters, sqrt((count(*) - 1) * var_pop(leave)) AS error FROM l GROUP BY 1)
SELECT system, round(estimate, 9) AS estimate, clusters, round(estimate - q * error, 8) AS low, round(estimate + q * error, 8) AS high FROM j JOIN t ON t.df = clusters - 1""")
def system_intervals(spark, sf):
    """Each system alone: ratio of sums and its t interval."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("system"), (F.col("l_suppkey") % 90).alias("cluster"), (F.col("l_discount") * F.col("l_quantity")).alias("num"), F.col("l_quantity").alias("den"))
    out = I.interval(I.jackknife(I.cluster_sums(rows, ["system"], "cluster", F.col("num"), F.col("den")), ["system"]))
    return out.select("system", F.round("estimate", 9).alias("estimate"), "clusters", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@query("""WITH k AS (SELECT l_returnflag AS system, unnest([{'name': 'status', 'value': l_linestatus}, {'name': 'device', 'value': CASE WHEN l_returnflag = 'N' THEN 'cpu' ELSE 'gpu' END}, {'name': 'version', 'value': 'v1'}]) AS p FROM lineitem),
d AS (SELECT p.name AS name, count(DISTINCT p.value) AS n FROM k GROUP BY 1 HAVING count(DISTINCT p.value) > 1) SELECT p.name AS name, system, list_sort(list(DISTINCT p.value)) AS "values" FROM k JOIN d ON d.name = p.name GROUP BY ALL""")
def scorer_gate(spark, sf):
    """Settings of the scorer that differ between or within systems, with the values each system has."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("system"), F.create_map(F.lit("status"), "l_linestatus", F.lit("device"), F.when(F.col("l_returnflag") == "N", "cpu").otherwise("gpu"), F.lit("version"), F.lit("v1")).alias("evaluator"))
    return C.scorer_differences(rows, "system", "evaluator")


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS x FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1)
SELECT CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN abs(a.x - b.x) > 1e5 THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def key_set_report(spark, sf):
    """Two evaluations that must have the same keys: what only one side has, and what changed."""
    a = table(spark, sf, "orders").filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("y"))
    return C.key_states(a, b, ["k"], F.abs(F.col("x") - F.col("y")) > 1e5).groupBy("state").agg(F.count("*").alias("n"))


GATE = "g AS (SELECT c_custkey AS uid, c_nationkey AS speaker, c_acctbal AS a, c_acctbal - 20 - c_custkey % 7 AS b, c_custkey % 5 AS q, c_custkey % 5 + (c_custkey % 3) / 10.0 + 0.2 AS r FROM customer)"


@query(f"""WITH {T}, {GATE}, x AS (SELECT uid, speaker, unnest([{{'m': 'wer', 'd': b - a}}, {{'m': 'cer', 'd': (b - a) / 2}}, {{'m': 'ovrl', 'd': (r - q)::DOUBLE}}, {{'m': 'sim', 'd': (r - q)::DOUBLE}}]) AS z FROM g),
s AS (SELECT z.m AS metric, speaker, sum(z.d) AS num, count(*)::DOUBLE AS den FROM x GROUP BY 1, 2), l AS (SELECT metric, sum(num) OVER w / sum(den) OVER w AS delta, (sum(num) OVER w - num) / (sum(den) OVER w - den) AS leave FROM s WINDOW w AS (PARTITION BY metric)),
j AS (SELECT metric, any_value(delta) AS delta, count(*) AS clusters, sqrt((count(*) - 1) * var_pop(leave)) AS error FROM l GROUP BY 1), c AS (SELECT metric, delta - q * error AS low, delta + q * error AS high FROM j JOIN t ON t.df = clusters - 1)
SELECT bool_and(CASE metric WHEN 'wer' THEN high < 0 WHEN 'cer' THEN high < 0 WHEN 'ovrl' THEN low > 0 ELSE low >= 0 END) AS passed, count(*) AS metrics FROM c""")
def promotion_gate(spark, sf):
    """Whether a checkpoint may replace another: both error rates fall for sure, quality rises for sure, similarity does not fall."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").alias("speaker"), F.lit("").alias("text"), "c_acctbal")
    before = c.select("uid", "speaker", "text", F.col("c_acctbal").alias("wer"), (F.col("c_acctbal") / 2).alias("cer"), (F.col("uid") % 5).cast("double").alias("ovrl"), (F.col("uid") % 5).cast("double").alias("sim"))
    worse = 20 + F.col("uid") % 7
    after = before.select("uid", "speaker", "text", (F.col("wer") - worse).alias("wer"), (F.col("cer") - worse / 2).alias("cer"), *((F.col(m) + (F.col("uid") % 3) / 10.0 + 0.2).alias(m) for m in ("ovrl", "sim")))
    changes = C.gate(before, after, ["uid"], "speaker", ["wer", "cer", "ovrl", "sim"], ["text"])
    passed = F.when(F.col("metric").isin("wer", "cer"), F.col("high") < 0).when(F.col("metric") == "ovrl", F.col("low") > 0).otherwise(F.col("low") >= 0)
    return changes.agg(F.bool_and(passed).alias("passed"), F.count("*").alias("metrics"))


NAMES = ("widget", "gizmo", "bolt", "plate", "ring", "gear")
FAMILY = "CASE " + " ".join(f"WHEN contains(lower({{0}}), '{f}') THEN '{f}'" for f in NAMES) + " ELSE lower({0}) END"


@query(f"SELECT item_id, i.name AS selector, p_name AS judge FROM items i JOIN part ON item_id = p_partkey WHERE {FAMILY.format('i.name')} = {FAMILY.format('p_name')}")
def judge_family_overlap(spark, sf):
    """Things that are selected and judged by models of one family; a name of no known family is a family of its own."""
    i = table(spark, sf, "items").select("item_id", F.col("name").alias("selector"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("judge"))
    return i.join(p, "item_id").filter(family_of(F.col("selector"), NAMES) == family_of(F.col("judge"), NAMES))


CORPORA = "s AS (SELECT l_partkey % 60 AS g, l_suppkey % 12 AS cluster, sum(l_discount * l_quantity) AS num, sum(l_quantity) AS den FROM lineitem GROUP BY 1, 2)"


def drawn_sql(draws: int, key: str = "'0:' || g || ':'") -> str:
    """The bootstrap in SQL over ``s`` (g, cluster, num, den): ``d`` (g, replicate, estimate)."""
    u = HASH.format(key + " || b || ':' || place")
    return f"""h AS (SELECT *, {HASH.format("'0:' || cluster")} AS h FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY h, cluster) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM h),
k AS (SELECT g, b, floor({u} * n)::BIGINT AS pick FROM o, range({draws}) r(b)), d AS (SELECT k.g, b AS replicate, sum(num) / sum(den) AS estimate FROM k JOIN o ON o.g = k.g AND o.place = k.pick GROUP BY ALL)"""


@query(f"""WITH {T}, {CORPORA}, {drawn_sql(200)}, a AS (SELECT sum(num) / sum(den) AS truth FROM s), l AS (SELECT g, sum(num) OVER w / sum(den) OVER w AS estimate, (sum(num) OVER w - num) / (sum(den) OVER w - den) AS leave FROM s WINDOW w AS (PARTITION BY g)),
j AS (SELECT g, any_value(estimate) AS estimate, count(*) AS clusters, sqrt((count(*) - 1) * var_pop(leave)) AS error FROM l GROUP BY 1),
i AS (SELECT 'jackknife_t' AS method, estimate - q * error AS low, estimate + q * error AS high FROM j LEFT JOIN t ON t.df = clusters - 1 UNION ALL SELECT 'percentile', quantile_cont(estimate, 0.025), quantile_cont(estimate, 0.975) FROM d GROUP BY g)
SELECT method, avg(coalesce(truth BETWEEN low AND high, false)::INT) AS covered, count(*) AS n FROM i, a GROUP BY 1""")
def interval_coverage(spark, sf):
    """How often t and percentile intervals over clusters hold the truth: sixty parts of the table, each against the ratio of the whole."""
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 60).alias("g"), (F.col("l_suppkey") % 12).alias("cluster"), "l_discount", "l_quantity")
    return I.covered(I.cluster_sums(rows, ["g"], "cluster", F.col("l_discount") * F.col("l_quantity"), F.col("l_quantity")), "g", "cluster")
