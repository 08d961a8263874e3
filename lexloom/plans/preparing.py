"""Prepare, merge and manifest queries over ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.expr import hash01, split_of
from lexloom.operators import prepare as P
from lexloom.operators.curate import first_reason
from lexloom.plans.curation import HASH, SPLIT
from lexloom.plans.registry import query, table

MESSAGE = r"""CASE WHEN quality IS NULL OR quality < 1 THEN 'Quality ' || coalesce(quality::VARCHAR, 'None') || ' below 1' WHEN regexp_matches(text, '\d') THEN 'Transcript contains digits' WHEN trim(coalesce(text, '')) = '' THEN 'Empty transcript'
WHEN trim(coalesce(source, '')) = '' THEN 'Missing speaker identity' WHEN coalesce(lang, 'en') NOT IN ('en', 'de') THEN 'Language tag not accepted: ' || lang WHEN n_chars < 300 OR n_chars > 6000 THEN 'Duration ' || n_chars || ' outside accepted range' WHEN n_chars % 100 = 7 THEN 'Silent audio' END"""


def labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def message():
    q, text = F.col("quality"), F.col("text")
    return P.messages(
        (q.isNull() | (q < 1), F.concat(F.lit("Quality "), F.coalesce(q.cast("string"), F.lit("None")), F.lit(" below 1"))),
        (text.rlike(r"\d"), "Transcript contains digits"),
        (F.trim(F.coalesce(text, F.lit(""))) == "", "Empty transcript"),
        (F.trim(F.coalesce("source", F.lit(""))) == "", "Missing speaker identity"),
        (~F.coalesce("lang", F.lit("en")).isin("en", "de"), F.concat(F.lit("Language tag not accepted: "), "lang")),
        ((F.col("n_chars") < 300) | (F.col("n_chars") > 6000), F.concat(F.lit("Duration "), F.col("n_chars").cast("string"), F.lit(" outside accepted range"))),
        (F.col("n_chars") % 100 == 7, "Silent audio"),
    )


@query(f"SELECT doc_id, {MESSAGE} AS error FROM documents LEFT JOIN labels USING (doc_id)")
def prepare_messages(spark, sf):
    """Each row's first broken rule with its message, in the order of cost."""
    return labelled(spark, sf).select("doc_id", message().alias("error"))


PREPARED = f"""p AS (SELECT doc_id, source, lang, text, {SPLIT} AS split, {MESSAGE} AS error, sha256(coalesce(text, '')) AS digest FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id) AS k FROM p WHERE error IS NULL)"""


@query(f"""WITH {PREPARED}, r AS (SELECT doc_id, CASE WHEN k > 1 THEN 'Duplicate audio or ID' END AS error, split, source FROM g UNION ALL SELECT doc_id, error, split, source FROM p WHERE error IS NOT NULL)
SELECT split, coalesce(regexp_extract(error, '^[A-Za-z]+'), 'accepted') AS outcome, count(*) AS n, count(DISTINCT source) AS sources FROM r GROUP BY ALL""")
def prepare_report(spark, sf):
    """One partition prepared: rules, then first-wins dedup by id and content, counted by split and outcome."""
    rows = labelled(spark, sf).select("doc_id", "source", split_of(F.col("doc_id")).alias("split"), message().alias("error"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    good = P.first_of_two(rows.filter("error is null"), "doc_id", "digest", "doc_id")
    good = good.select("doc_id", "source", "split", F.when(F.col("duplicate"), F.lit("Duplicate audio or ID")).alias("error"))
    both = rows.filter("error is not null").select("doc_id", "source", "split", "error").unionByName(good)
    outcome = F.coalesce(F.regexp_extract("error", "^[A-Za-z]+", 0), F.lit("accepted"))
    return both.groupBy("split", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query()
def two_key_dedup(spark, sf):
    """First-wins by two keys at once: half of doc_id, and the text's digest."""
    rows = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("uid"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return P.first_of_two(rows, "uid", "digest", "doc_id").select("doc_id", "duplicate")


MERGED = f"""m AS (SELECT doc_id, source, lang, n_chars, CASE WHEN lang = 'de' THEN 'test' ELSE 'train' END AS split, {HASH.format("'3:' || source || '/' || lang")} < 0.3 AS moves, sha256(coalesce(text, '')) AS digest, doc_id % 4 AS part FROM documents), a AS (SELECT *, row_number() OVER (ORDER BY part, doc_id) AS arrival FROM m),
f AS (SELECT *, first_value(source || '/' || lang) OVER w AS fl, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY digest ORDER BY arrival)),
c AS (SELECT * FROM f WHERE k = 1), d AS (SELECT * FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), s AS (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n FROM d),
t AS (SELECT n_chars::DOUBLE AS v FROM s WHERE n >= 2 AND split = 'train' AND NOT moves)"""


@query(f"""WITH {MERGED} SELECT (SELECT count(*) FROM f WHERE k > 1 AND source || '/' || lang = fl) AS duplicates, (SELECT count(*) FROM f WHERE source || '/' || lang <> fl) AS conflicts,
(SELECT count(*) FROM c) - (SELECT count(*) FROM d) AS dropped, (SELECT count(*) FROM s WHERE n < 2) AS singletons, (SELECT count(*) FROM s WHERE n >= 2) AS samples,
(SELECT count(*) FROM c WHERE moves AND split <> 'val') AS reassigned, (SELECT count(*) FROM t) AS train_rows, (SELECT round(avg(v), 6) FROM t) AS train_mean, (SELECT round(stddev_pop(v), 4) FROM t) AS train_std, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE n >= 2)) AS orphans""")
def merge_report(spark, sf):
    """Four partitions merged in order: copies, conflicting copies, dropped ids, single speakers, what is left; splits by a map, statistics of train rows, side rows that lost their sample."""
    speaker = F.concat_ws("/", "source", "lang")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), speaker.alias("speaker"), F.lit("").alias("text"), F.when(F.col("lang") == "de", "test").otherwise("train").alias("split"), F.array(F.col("n_chars").cast("double")).alias("z"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.struct((F.col("doc_id") % 4).alias("part"), "doc_id").alias("arrival"))
    drop = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("uid"))
    names = rows.select("speaker").distinct()
    moves = names.filter(hash01(F.lit("3"), "speaker") < 0.3).withColumn("mapped", F.lit("val"))
    kept, gone = P.merged(rows, True, drop, split_map=moves, vector="z")
    _, orphans = P.cleaned(table(spark, sf, "labels").withColumnRenamed("doc_id", "uid"), kept, "uid")
    n, mean, std = gone["channels"][0]
    counts = ("duplicates", "conflicts", "dropped", "singletons", "samples", "reassigned")
    return spark.createDataFrame([(*(gone[c] for c in counts), n, round(mean, 6), round(std, 4), orphans)], ", ".join(f"{c} long" for c in counts) + ", train_rows long, train_mean double, train_std double, orphans long")


MANIFEST = rf"""c AS (SELECT doc_id AS id, source, text, n_chars, n_chars / 15.0::DOUBLE AS seconds, (doc_id % 23) * 1000 AS bandwidth, n_chars::DOUBLE / greatest(len(string_split(text, ' ')), 1) AS rate FROM documents WHERE {HASH.format("'0:' || doc_id")} < 0.8),
r AS (SELECT *, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' WHEN regexp_matches(text, '[#*$%&|<>]{{3}}') THEN 'markup' WHEN seconds < 10 OR seconds > 600 THEN 'duration' WHEN bandwidth < 4000 THEN 'bandwidth' END AS reason FROM c),
q AS (SELECT quantile_cont(rate, 0.25) AS a, quantile_cont(rate, 0.75) AS b FROM r WHERE reason IS NULL), o AS (SELECT r.* REPLACE (coalesce(reason, CASE WHEN rate < a - 1.5 * (b - a) OR rate > b + 1.5 * (b - a) THEN 'rate_outlier' END) AS reason) FROM r, q),
k AS (SELECT *, row_number() OVER (PARTITION BY source, reason IS NULL ORDER BY id) AS k FROM o), m AS (SELECT id, source, seconds, coalesce(reason, CASE WHEN k > 20 THEN 'group_cap' END) AS reason FROM k)"""


def manifest(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text", "n_chars")
    c = d.withColumn("seconds", F.col("n_chars") / 15.0).withColumn("bandwidth", F.col("id") % 23 * 1000).withColumn("rate", F.col("n_chars") / F.greatest(F.size(F.split("text", " ")), F.lit(1)))
    meta = [("empty_text", F.trim(F.coalesce("text", F.lit(""))) == ""), ("markup", F.col("text").rlike("[#*$%&|<>]{3}")), ("duration", (F.col("seconds") < 10) | (F.col("seconds") > 600))]
    return P.build_manifest(c, meta, [("bandwidth", F.col("bandwidth") < 4000)], "rate", hash01(F.lit("0"), F.col("id").cast("string")) < 0.8, ("source", 20))


@query(f"WITH {MANIFEST} SELECT id, source, seconds FROM m WHERE reason IS NULL")
def manifest_rows(spark, sf):
    """What the builder keeps: sampled, ruled, measured, fenced, capped."""
    return manifest(spark, sf)[0].select("id", "source", "seconds")


@query(f"WITH {MANIFEST} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, round(sum(seconds), 3) AS seconds FROM m GROUP BY 1")
def manifest_summary(spark, sf):
    rows = manifest(spark, sf)[1].groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))


@query(r"""SELECT doc_id, regexp_matches(replace(lower(translate(text, 'İI', 'iı')), chr(10), ' '), '\[(müzik|alkış|gülme|music|applause|laughter)\]|♪|^\s*[(\[][^)\]]*[)\]]\s*$') AS markup FROM documents""")
def caption_markup(spark, sf):
    """Captions that are no speech: sounds in brackets, notes, or nothing but an aside."""
    low = F.replace(F.lower(F.translate("text", "İI", "iı")), F.lit("\n"), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", low.rlike(r"\[(müzik|alkış|gülme|music|applause|laughter)\]|♪|^\s*[(\[][^)\]]*[)\]]\s*$").alias("markup"))


@query("""SELECT doc_id, coalesce(nullif(lang, ''), 'en') IN ('en', 'de') AS listed, true AS with_any, regexp_matches(text, '\\d|[$€£%]|\\b(?:Dr|Mr|Mrs|Ms|St|vs|etc)\\.') AS ambiguous FROM documents""")
def language_and_ambiguity(spark, sf):
    """Language gates with a default tag for rows without one, the wildcard, and what English text must spell out."""
    return table(spark, sf, "documents").select("doc_id", language_ok(F.col("lang"), {"en", "de"}).alias("listed"), language_ok(F.col("lang"), {"any"}).alias("with_any"), F.col("text").rlike(r"\d|[$€£%]|\b(?:Dr|Mr|Mrs|Ms|St|vs|etc)\.").alias("ambiguous"))


def language_ok(lang, accepted: set[str], default: str | None = None):
    if accepted == {"any"}:
        return F.lit(True)
    return F.coalesce(F.nullif(lang, F.lit("")), F.lit(default or sorted(accepted)[-1])).isin(*sorted(accepted))


@query("""WITH s AS (SELECT doc_id, CASE WHEN quality IS NULL THEN 'nan'::DOUBLE ELSE quality::DOUBLE END AS score FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, isnan(score) AS unscored, CASE WHEN NOT isnan(score) THEN score END AS score FROM s""")
def lookup_scores(spark, sf):
    """Scores looked up by id, NaN where there is none."""
    score = F.coalesce(F.col("quality").cast("double"), F.lit(float("nan")))
    s = labelled(spark, sf).select("doc_id", score.alias("s"))
    return s.select("doc_id", F.isnan("s").alias("unscored"), F.when(~F.isnan("s"), F.col("s")).alias("score"))


@query("""WITH c AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k FROM documents) SELECT doc_id FROM c WHERE k <= 400 AND n_chars > 1000""")
def limit_before_filter(spark, sf):
    """The limit counts candidates that were looked at, not those that passed."""
    return table(spark, sf, "documents").orderBy("doc_id").limit(400).filter("n_chars > 1000").select("doc_id")


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 31 = 4 THEN 'bad header' END AS error, CASE WHEN doc_id % 37 <> 5 THEN n_chars / 15.0 END AS seconds, (doc_id % 13) * 1e-5 AS level, (doc_id % 23) * 1000 AS bandwidth, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 11) / 10.0 END AS speech FROM documents)
SELECT doc_id, CASE WHEN error IS NOT NULL THEN 'decode_error' WHEN NOT coalesce(seconds BETWEEN 10 AND 600, false) THEN 'duration' WHEN level < 1e-5 THEN 'silent' WHEN bandwidth < 4000 THEN 'bandwidth' WHEN speech < 0.2 THEN 'speech_ratio' END AS reason FROM m""")
def measured_reasons(spark, sf):
    """The first measured rule that a row breaks: decoding, length, silence, bandwidth, share of speech."""
    i = F.col("doc_id")
    rules = P.measured_rules(
        F.when(i % 31 == 4, "bad header"), F.when(i % 37 != 5, F.col("n_chars") / 15.0), (i % 13) * F.lit(1e-5), i % 23 * 1000, F.when(i % 3 > 0, i % 11 / 10.0),
        10, 600, 1e-5, 4000, 0.2,
    )
    return table(spark, sf, "documents").select("doc_id", first_reason(*rules).alias("reason"))


@query(f"""WITH d AS (SELECT DISTINCT source, substr(source, 1, 4) AS key FROM documents), given(name, mapped) AS (VALUES ('src11', 'test'), ('src1', 'val'), ('src3', 'train'))
SELECT source, coalesce(a.mapped, b.mapped, CASE WHEN key <> 'src9' THEN CASE WHEN {HASH.format("'0:' || key")} < 0.3 THEN 'test' WHEN {HASH.format("'0:' || key")} < 0.6 THEN 'val' ELSE 'train' END END, 'kept') AS split FROM d LEFT JOIN given a ON a.name = source LEFT JOIN given b ON b.name = key""")
def split_lookup(spark, sf):
    """A label's entry in the map, else its key's, else the key's hash, else the split it had (labels without a key)."""
    given = F.broadcast(spark.createDataFrame([("src11", "test"), ("src1", "val"), ("src3", "train")], "name string, mapped string"))  # a file's few lines
    d = table(spark, sf, "documents").select("source").distinct().withColumn("key", F.substring("source", 1, 4))
    by_label = d.join(given.select(F.col("name").alias("source"), F.col("mapped").alias("m1")), "source", "left")
    by_key = by_label.join(given.select(F.col("name").alias("key"), F.col("mapped").alias("m2")), "key", "left")
    return by_key.select("source", F.coalesce("m1", "m2", F.when(F.col("key") != "src9", split_of(F.col("key"), 0, 0.3, 0.6)), F.lit("kept")).alias("split"))
