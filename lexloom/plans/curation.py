"""Curation: reasons, yields, samples, splits, dedup, contamination, drop lists, fences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.expr import ascii_metric_text, finite, hash01, length_bucket, split_of, words
from lexloom.operators import curate
from lexloom.plans.registry import query, table

KEY = r"trim(regexp_replace(regexp_replace(replace(lower({0}), '’', ''''), '[^a-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g'))"
HASH = "('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"
SPLIT = f"CASE WHEN {HASH.format("'0:' || doc_id")} < 0.01 THEN 'test' WHEN {HASH.format("'0:' || doc_id")} < 0.02 THEN 'val' ELSE 'train' END"
REASON = r"CASE WHEN trim(text) = '' THEN 'empty_text' WHEN n_chars < 100 THEN 'short' WHEN n_chars > 10000 THEN 'long' WHEN regexp_matches(text, '[#*$%&|<>]{3}') THEN 'symbols' WHEN regexp_matches(text, '\d') THEN 'digits' END"
NGRAMS = "CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
CONTAMINATION = f"""
b AS (SELECT DISTINCT {KEY.format('text')} AS s FROM benchmark), bw AS (SELECT s, string_split(s, ' ') AS w FROM b WHERE s <> ''), bg AS (SELECT s, len(w) AS n, {NGRAMS} AS g FROM bw),
d AS (SELECT doc_id, {KEY.format('text')} AS s FROM documents), dw AS (SELECT doc_id, s, list_filter(string_split(s, ' '), lambda x: x <> '') AS w FROM d), dg AS (SELECT doc_id, s, {NGRAMS} AS g FROM dw),
o AS (SELECT doc_id, bs AS s, count(*) AS c FROM (SELECT doc_id, unnest(g) AS x FROM dg) a JOIN (SELECT s AS bs, unnest(g) AS x FROM bg) q USING (x) GROUP BY ALL),
r AS (SELECT DISTINCT doc_id, 1 AS k FROM d JOIN b ON d.s = b.s AND b.s <> '' UNION
  SELECT DISTINCT d.doc_id, 2 FROM d JOIN bg ON bg.n >= 5 AND contains(' ' || d.s || ' ', ' ' || bg.s || ' ') UNION
  SELECT DISTINCT o.doc_id, 3 FROM o JOIN dg USING (doc_id) JOIN bg ON bg.s = o.s WHERE least(len(dg.g), len(bg.g)) >= 2 AND o.c::DOUBLE / least(len(dg.g), len(bg.g)) >= 0.8),
cont AS (SELECT doc_id AS key, ['exact', 'contains', 'near'][min(k)] AS reason FROM r GROUP BY doc_id)"""


def docs(spark, sf):
    return table(spark, sf, "documents")


def reason():
    c = F.col("text")
    return curate.first_reason(("empty_text", F.trim(c) == ""), ("short", F.col("n_chars") < 100), ("long", F.col("n_chars") > 10000), ("symbols", c.rlike("[#*$%&|<>]{3}")), ("digits", c.rlike(r"\d")))


def contamination(spark, sf):
    keyed = docs(spark, sf).select(F.col("doc_id").alias("key"), ascii_metric_text(F.col("text")).alias("norm"))
    return curate.contaminated(keyed, table(spark, sf, "benchmark").select(ascii_metric_text(F.col("text")).alias("norm")))


@query(f"WITH {CONTAMINATION} SELECT key, reason FROM cont")
def contamination_match(spark, sf):
    """Documents that equal, contain or nearly equal a held-out sentence."""
    return contamination(spark, sf)


@query(f"""WITH {CONTAMINATION}, f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)),
c AS (SELECT {SPLIT} AS split, coalesce({REASON}, cont.reason, CASE WHEN f.doc_id IS NULL THEN 'duplicate' END, 'kept') AS reason, n_chars
  FROM documents LEFT JOIN cont ON cont.key = documents.doc_id LEFT JOIN f USING (doc_id))
SELECT split, reason, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM c GROUP BY ALL""")
def curation_yield(spark, sf):
    """Flagship: rules, contamination, content dedup and split in one report."""
    d = docs(spark, sf)
    first = d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(1).alias("first"))
    hit = contamination(spark, sf).select(F.col("key").alias("doc_id"), F.col("reason").alias("held_out"))
    rows = d.join(hit, "doc_id", "left").join(first, "doc_id", "left")
    why = F.coalesce(reason(), F.col("held_out"), F.when(F.col("first").isNull(), "duplicate"), F.lit("kept"))
    return rows.select(split_of(F.col("doc_id")).alias("split"), why.alias("reason"), "n_chars").groupBy("split", "reason").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"SELECT doc_id, {REASON} AS reason FROM documents")
def classify_reasons(spark, sf):
    return docs(spark, sf).select("doc_id", reason().alias("reason"))


@query(f"WITH c AS (SELECT {REASON} AS reason, n_chars FROM documents) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM c GROUP BY 1")
def reason_yield(spark, sf):
    d = docs(spark, sf).select(F.coalesce(reason(), F.lit("kept")).alias("reason"), "n_chars").groupBy("reason").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query(f"SELECT doc_id, source FROM documents WHERE {HASH.format("'7:' || doc_id")} < 0.25")
def hash_sample(spark, sf):
    return curate.hash_sample(docs(spark, sf), "doc_id", 0.25, 7).select("doc_id", "source")


@query(f"SELECT doc_id, {SPLIT} AS split FROM documents")
def split_assign(spark, sf):
    return docs(spark, sf).select("doc_id", split_of(F.col("doc_id")).alias("split"))


@query(f"SELECT {SPLIT} AS split, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def split_counts(spark, sf):
    return docs(spark, sf).groupBy(split_of(F.col("doc_id")).alias("split")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 3000 AND lang IN ('en', 'de')")
def language_range_gate(spark, sf):
    return docs(spark, sf).filter(F.col("n_chars").between(500, 3000) & F.col("lang").isin("en", "de")).select("doc_id", "source", "n_chars")


@query(r"SELECT doc_id, regexp_matches(text, '\d') AS has_digit FROM documents")
def digit_gate(spark, sf):
    return docs(spark, sf).select("doc_id", F.col("text").rlike(r"\d").alias("has_digit"))


@query("SELECT event_type, count(value) AS n, avg(value) AS mean FROM (SELECT event_type, CASE WHEN isfinite(value) THEN value END AS value FROM events) GROUP BY 1")
def finite_mean(spark, sf):
    return table(spark, sf, "events").withColumn("v", finite(F.col("value"))).groupBy("event_type").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


@query("SELECT doc_id, CASE WHEN quality < 1 THEN 'quality' WHEN toxic > 0 THEN 'toxic' WHEN n_chars < 300 THEN 'short' WHEN quality IS NULL THEN 'unscored' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def drop_list(spark, sf):
    rows = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    rules = {"quality": F.col("quality") < 1, "toxic": F.col("toxic") > 0, "short": F.col("n_chars") < 300}
    return curate.drop_list(rows, rules, ["quality", "toxic"]).select("doc_id", "reason")


@query("SELECT doc_id, CASE WHEN n_chars < 300 THEN 'short' END AS reason FROM documents")
def drop_list_disabled_rule(spark, sf):
    """A score that no row has switches its rule off."""
    rows = docs(spark, sf).withColumn("dnsmos", F.lit(None).cast("double"))
    return curate.drop_list(rows, {"dnsmos": F.col("dnsmos") < 1, "short": F.col("n_chars") < 300}, ["dnsmos"]).select("doc_id", "reason")


@query(r"SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 9 THEN '6-9' ELSE '10+' END AS bucket, count(*) AS docs FROM (SELECT len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n FROM documents) GROUP BY 1")
def length_buckets(spark, sf):
    return docs(spark, sf).groupBy(length_bucket(F.size(words(F.col("text")))).alias("bucket")).agg(F.count("*").alias("docs"))


@query("""SELECT bin, coalesce(n, 0) AS n FROM (VALUES ('<=500'), ('<=1000'), ('<=2000'), ('<=5000'), ('>5000')) v(bin)
LEFT JOIN (SELECT CASE WHEN n_chars <= 500 THEN '<=500' WHEN n_chars <= 1000 THEN '<=1000' WHEN n_chars <= 2000 THEN '<=2000' WHEN n_chars <= 5000 THEN '<=5000' ELSE '>5000' END AS bin, count(*) AS n FROM documents GROUP BY 1) USING (bin)""")
def range_histogram(spark, sf):
    """Right-closed bins, empty ones shown as zero."""
    edges = (500, 1000, 2000, 5000)
    label = F.lit(f">{edges[-1]}")
    for e in reversed(edges):
        label = F.when(F.col("n_chars") <= e, f"<={e}").otherwise(label)
    counts = docs(spark, sf).groupBy(label.alias("bin")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(f"<={e}",) for e in edges] + [(f">{edges[-1]}",)], "bin string")
    return names.join(counts, "bin", "left").fillna(0, ["n"])


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY sha256(text)")
def dedup_digest_first(spark, sf):
    return curate.first_wins(docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest")), ["digest"], "doc_id")


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf):
    return docs(spark, sf).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("SELECT sha256(text) AS digest, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def conflict_duplicates(spark, sf):
    """Equal content under several labels."""
    return docs(spark, sf).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count_distinct("source").alias("sources")).filter("sources > 1")


@query("SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) >= 2)")
def singleton_removal(spark, sf):
    d = docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest"))
    many = d.groupBy("digest").agg(F.count("*").alias("n")).filter("n >= 2")
    return d.join(many, "digest", "left_semi").select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def orphan_anti_join(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_keep(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_labels(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("""WITH q AS (SELECT source, quantile_cont(n_chars::DOUBLE, 0.25) AS a, quantile_cont(n_chars::DOUBLE, 0.75) AS b FROM documents GROUP BY 1)
SELECT source, a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM q""")
def tukey_fences(spark, sf):
    return curate.fences(docs(spark, sf), "source", "n_chars")


@query("""WITH q AS (SELECT source, quantile_cont(n_chars::DOUBLE, 0.25) AS a, quantile_cont(n_chars::DOUBLE, 0.75) AS b FROM documents GROUP BY 1)
SELECT doc_id, source FROM documents JOIN q USING (source) WHERE n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a)""")
def tukey_outliers(spark, sf):
    d = docs(spark, sf)
    return d.join(curate.fences(d, "source", "n_chars"), "source").filter("n_chars < low or n_chars > high").select("doc_id", "source")


@query(f"SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {HASH.format("'3:' || doc_id")}, doc_id) AS r FROM documents) WHERE r <= 5")
def topk_hash_per_group(spark, sf):
    return curate.capped(docs(spark, sf).select("source", "doc_id"), "source", [hash01(F.lit("3"), F.col("doc_id").cast("string")), "doc_id"], 5)


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE {REASON} IS NULL) WHERE r <= 10")
def speaker_cap(spark, sf):
    """The cap counts survivors only."""
    return curate.capped(docs(spark, sf).filter(reason().isNull()).select("doc_id", "source"), "source", ["doc_id"], 10)


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 300")
def limit_evaluated(spark, sf):
    return docs(spark, sf).orderBy("doc_id").limit(300).select("doc_id", "source", "n_chars")


@query("SELECT source, count(*) AS n, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY 1")
def source_summary(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("lang")).alias("langs"))


@query(f"""SELECT source, coalesce(CASE source WHEN 'src1' THEN 'test' WHEN 'src2' THEN 'val' END, CASE WHEN {HASH.format("'0:' || source")} < 0.1 THEN 'test' WHEN {HASH.format("'0:' || source")} < 0.2 THEN 'val' ELSE 'train' END) AS split, count(*) AS n FROM documents GROUP BY ALL""")
def split_map_fallback(spark, sf):
    """A label's entry in the map, else its hash."""
    given = spark.createDataFrame([("src1", "test"), ("src2", "val")], "source string, mapped string")
    d = docs(spark, sf).groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(given), "source", "left")
    return d.select("source", F.coalesce("mapped", split_of(F.col("source"), 0, 0.1, 0.2)).alias("split"), "n")
