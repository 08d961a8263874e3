"""Pairs, samples, packings and token layouts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.expr import byte_tokens, hash01
from lexloom.plans.curation import HASH
from lexloom.plans.registry import query, table


@query(f"""WITH h AS (SELECT conv_id, turn, length(text) BETWEEN 20 AND 400 AS ok, {HASH.format("'6:' || conv_id || ':' || turn")} AS h FROM conversations),
p AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY conv_id ORDER BY h, turn), 0) AS upto, sum(ok::INT) OVER (PARTITION BY conv_id) AS m FROM h), e AS (SELECT conv_id, upto - 1 AS i, turn AS prompt FROM p WHERE ok)
SELECT p.conv_id, p.turn, e.prompt FROM p, (VALUES (0), (1)) j(j) JOIN e ON e.conv_id = p.conv_id AND e.i = (p.upto + j.j) % p.m WHERE m - ok::INT > j""")
def pair_sample(spark, sf):
    """Two prompts of bounded length for each target: the next ones after it in a seeded order of its group, round to the first; an equi-join on places."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").between(20, 400).alias("ok"), hash01(F.lit("6"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("h"))
    one = F.col("ok").cast("int")
    p = c.withColumn("upto", F.sum(one).over(Window.partitionBy("conv_id").orderBy("h", "turn").rowsBetween(Window.unboundedPreceding, 0)))
    m = c.groupBy("conv_id").agg(F.sum(one).alias("m"))
    e = p.filter("ok").select("conv_id", (F.col("upto") - 1).alias("i"), F.col("turn").alias("prompt"))
    asked = p.join(m, "conv_id").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).filter(F.col("m") - one > F.col("j"))
    return asked.withColumn("i", (F.col("upto") + F.col("j")) % F.col("m")).join(e, ["conv_id", "i"]).select("conv_id", "turn", "prompt")


@query(f"""WITH w AS (SELECT source, count(*)::DOUBLE ** -0.5 AS p FROM documents GROUP BY 1), c AS (SELECT source, sum(p) OVER (ORDER BY source) / sum(p) OVER () AS hi, (sum(p) OVER (ORDER BY source) - p) / sum(p) OVER () AS lo FROM w),
d AS (SELECT i AS draw, {HASH.format("'9:' || i")} AS u FROM range(0, 200) t(i)) SELECT draw, source FROM d JOIN c ON u >= lo AND u < hi""")
def weighted_sample(spark, sf):
    """Draws with replacement, weight count ** -0.5: one row a source, matched by range."""
    w = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", F.pow(F.col("n").cast("double"), F.lit(-0.5)).alias("p"))
    every, upto = Window.partitionBy(), Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    c = w.select("source", (F.sum("p").over(upto) / F.sum("p").over(every)).alias("hi"), ((F.sum("p").over(upto) - F.col("p")) / F.sum("p").over(every)).alias("lo"))
    draws = spark.range(200).select(F.col("id").alias("draw"), hash01(F.lit("9"), F.col("id").cast("string")).alias("u"))
    return draws.join(F.broadcast(c), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "source")


def _fold(costs, limit):
    """Greedy prefix packing over an array in order: what does not fit is skipped."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc, x):
        fits = acc["total"] + x["cost"] <= limit
        return F.struct(F.when(fits, acc["total"] + x["cost"]).otherwise(acc["total"]).alias("total"), F.when(fits, F.concat(acc["taken"], F.array(x["id"]))).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(costs, start, step)


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r(conv_id, k, total, taken) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM o UNION ALL
SELECT r.conv_id, o.k, CASE WHEN r.total + o.cost <= 600 THEN r.total + o.cost ELSE r.total END, CASE WHEN r.total + o.cost <= 600 THEN list_append(r.taken, o.turn) ELSE r.taken END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, max_by(total, k) AS total, max_by(taken, k) AS taken FROM r GROUP BY 1""")
def prefix_packing(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("id"), F.length("text").cast("long").alias("cost"))))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(rows.alias("rows")).withColumn("p", _fold(F.col("rows"), 600))
    return g.select("conv_id", F.col("p.total").alias("total"), F.col("p.taken").alias("taken"))


@query()
def batch_packing(spark, sf):
    """Buckets of 4096 by seeded hash, sorted by cost; a batch is cut at 16 rows or when cost * (rows + 1) passes the budget."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, batch, size, most = pdf.sort_values(["n_chars", "doc_id"]), [], 0, 0, 0
        for cost in pdf["n_chars"]:
            if size and (size == 16 or max(most, cost) * (size + 1) > 60_000):
                batch, size, most = batch + 1, 0, 0
            size, most = size + 1, max(most, cost)
            out.append(batch)
        return pdf[["bucket", "doc_id"]].assign(batch=out)

    d = table(spark, sf, "documents")
    n = max(1, -(-d.count() // 4096))
    return d.select((F.floor(hash01(F.lit("11"), F.col("doc_id").cast("string")) * n)).cast("long").alias("bucket"), "doc_id", "n_chars").groupBy("bucket").applyInPandas(pack, "bucket long, doc_id long, batch long")


@query("SELECT item_id, list_concat([1], [c + 4 for c in list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), i * 2 + 1, 2))::INT)], [2]) AS ids FROM benchmark")
def byte_token_ids(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", byte_tokens(F.col("text")).alias("ids"))


@query("SELECT item_id, strlen(text) + 2 AS n_reference, [1, 2, 3] AS marks, 2 * strlen(text) + 3 AS joined_length FROM benchmark")
def assemble_tokens(spark, sf):
    """begin + reference + separator + target + end, here with the text as both."""
    ids = F.slice(byte_tokens(F.col("text")), 2, F.octet_length("text"))
    joined = F.concat(F.array(F.lit(1)), ids, F.array(F.lit(2)), ids, F.array(F.lit(3)))
    marks = F.array(joined[0], joined[F.octet_length("text") + 1], F.element_at(joined, -1))
    return table(spark, sf, "benchmark").select("item_id", F.size(byte_tokens(F.col("text"))).alias("n_reference"), marks.alias("marks"), F.size(joined).alias("joined_length"))


@query("SELECT conv_id, turn, max(length(text)) OVER (PARTITION BY conv_id) - length(text) AS padding FROM conversations")
def collate_padding(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.max(F.length("text")).over(Window.partitionBy("conv_id")) - F.length("text")).alias("padding"))


@query("SELECT d.doc_id, t.tempo FROM documents d, (VALUES (900), (1000), (1100)) t(tempo) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def store_coverage(spark, sf):
    """(uid, tempo) pairs that a side store lacks, of every document."""
    wanted = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (900, 1000, 1100)))).alias("tempo"))
    return wanted.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
