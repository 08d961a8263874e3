"""Durations, fits and hooks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import arrays as A
from lexloom.functions import duration, hooks
from lexloom.functions.specs import named_values
from lexloom.plans.registry import query, table

PAIR = "p AS (SELECT conv_id, turn, text AS t, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), x AS (SELECT *, (length(r) * (1 + (conv_id + turn) % 9) / 3.0)::DOUBLE AS frames FROM p WHERE r IS NOT NULL AND length(r) > 0)"
VOWELS = "len(regexp_extract_all({0}, '[aeıioöuüâîû]'))"
WORDS = r"len(list_filter(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' '), lambda x: x <> ''))"


def spoken_pairs(spark, sf):
    """A turn, the one before it as its voice prompt, and the prompt's frames."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("t"), F.lag("text").over(w).alias("r")).filter("r is not null and length(r) > 0")
    return c.withColumn("frames", F.length("r") * (1 + (F.col("conv_id") + F.col("turn")) % 9) / 3.0)


@query(f"""WITH {PAIR}, s AS (SELECT *, length(r) / greatest(frames / 25.0, 1e-3) AS rate FROM x)
SELECT conv_id, turn, frames / greatest(strlen(r), 1) * greatest(strlen(t), 1) AS byte_rule, frames / greatest({VOWELS.format('r')}, 1) * greatest({VOWELS.format('t')}, 1) AS syllable_rule, rate, CASE WHEN rate <= 17.0 THEN 1.0 ELSE least(rate / 16.0, 1.2) END::DOUBLE AS scale, CASE WHEN rate < 13.0 THEN 'predictor' WHEN rate > 17.0 THEN 'clamp' ELSE 'rule' END AS mode FROM s""")
def duration_rule(spark, sf):
    """Frames by bytes and by syllables, the prompt's speaking rate, the clamp, and which rule `auto` takes."""
    x = spoken_pairs(spark, sf)
    f, r, t = F.col("frames"), F.col("r"), F.col("t")
    return x.select("conv_id", "turn", duration.rule_frames(f, r, t).alias("byte_rule"), duration.rule_frames(f, r, t, "syllables").alias("syllable_rule"), duration.speaking_rate(f, r).alias("rate"), duration.clamp_scale(f, r).alias("scale"), duration.auto_mode(f, r).alias("mode"))


@query(rf"""WITH {PAIR}, s AS (SELECT *, frames / 40.0 AS speech, {VOWELS.format('r')} AS a, {VOWELS.format('t')} AS b, regexp_replace(t, '[\s.!?,;:…"''»”’)\]-]+$', '') AS body FROM x)
SELECT conv_id, turn, CASE WHEN speech > 0 AND a > 0 THEN greatest(greatest(b, 1) / least(greatest(a / speech, 3.0), 8.5) + (len(regexp_extract_all(body, '[,;:]|\s-\s')) * 0.15::DOUBLE + len(regexp_extract_all(body, '[.!?…]+')) * 0.3::DOUBLE), 0.5) END AS seconds FROM s""")
def articulation(spark, sf):
    """Seconds by syllables, the prompt's net rate and the punctuation's pauses."""
    x = spoken_pairs(spark, sf)
    return x.select("conv_id", "turn", duration.articulation_seconds(F.col("frames") / 40.0, F.col("r"), F.col("t")).alias("seconds"))


#: A fitted predictor's form; the numbers are of this repository's own test data.
WEIGHTS = (0.4, 0.6, 0.05, 0.3, 0.2, 0.1, 0.5, 0.35, 0.02)


@query(rf"""WITH {PAIR}, u AS (SELECT *, greatest({VOWELS.format('t')}, 1) AS ts, greatest({WORDS.format('t')}, 1) AS tw, greatest(strlen(t), 1) AS tb, len(regexp_extract_all(t, '[,;:-]')) AS tc, len(regexp_extract_all(t, '[.!?]+')) AS tp, greatest({VOWELS.format('r')}, 1) AS rs, greatest(strlen(r), 1) AS rb FROM x)
SELECT conv_id, turn, exp(0.4::DOUBLE + 0.6::DOUBLE * ln(ts) + 0.05::DOUBLE * ln(tw) + 0.3::DOUBLE * ln(tb) + 0.2::DOUBLE * tc / tw + 0.1::DOUBLE * tp / tw + 0.5::DOUBLE * ln(frames / rs) + 0.35::DOUBLE * ln(frames / rb) + 0.02::DOUBLE * ln(greatest(frames, 1))) AS frames FROM u""")
def predicted_frames(spark, sf):
    """Frames by the log-linear predictor of nine features."""
    x = spoken_pairs(spark, sf)
    return x.select("conv_id", "turn", duration.predicted_frames(WEIGHTS, duration.features(F.col("frames"), F.col("r"), F.col("t"))).alias("frames"))


@query()
def ridge_fit(spark, sf):
    """The nine weights, fitted on log frames of pairs."""
    x = spoken_pairs(spark, sf)
    w = duration.ridge(x, duration.features(F.col("frames"), F.col("r"), F.col("t")), F.ln(F.length("t") * 1.5))
    return spark.createDataFrame([(n, float(v)) for n, v in zip(duration.FEATURES, w, strict=True)], "feature string, weight double")


@query()
def principal_components(spark, sf):
    """Three components of the vectors, and the rows projected on them."""
    v = table(spark, sf, "embeddings")
    mean, parts, _ = duration.principal_components(v, "embedding", 64, 3)
    return v.select("vec_id", A.projected(F.col("embedding"), mean.tolist(), parts.tolist()).alias("projected"))


@query("SELECT doc_id, length(trim(text)) AS n FROM documents")
def hooked_lengths(spark, sf):
    """A function named MODULE:FUNCTION over a column, imported once a worker."""
    bare = F.regexp_replace("text", "^ +| +$", "")
    return table(spark, sf, "documents").select("doc_id", hooks.mapped("builtins:len", "int")(bare).alias("n"))


@query("SELECT l_orderkey, max_by(l_linenumber, (l_quantity, -l_linenumber)) AS l_linenumber FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def hooked_selection(spark, sf):
    """The candidate that a named function picks in each group (an order's lines)."""
    x = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return hooks.selected(x, "l_orderkey", "l_linenumber", "lexloom.plans.speaking:most_quantity", ["l_quantity"])


def most_quantity(frame) -> int:
    return int(frame["l_quantity"].to_numpy().argmax())


@query(r"""WITH q AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages WHERE contains(url, '?')), p AS (SELECT page_id, unnest(list_filter(string_split(q, '&'), lambda x: trim(x) <> '')) AS part FROM q),
n AS (SELECT page_id, CASE WHEN contains(part, '=') THEN trim(substr(part, 1, strpos(part, '=') - 1)) END AS name, CASE WHEN contains(part, '=') THEN substr(part, strpos(part, '=') + 1) END AS value FROM p)
SELECT page_id, name, value, CASE WHEN coalesce(name, '') = '' THEN 'no name' WHEN count(*) OVER (PARTITION BY page_id, name) > 1 THEN 'repeated' END AS problem FROM n""")
def parsed_specification(spark, sf):
    """The name=value specification in each page's address, with what is wrong in it."""
    q = table(spark, sf, "pages").filter(F.col("url").contains("?")).select("page_id", F.regexp_extract("url", r"\?([^#]*)", 1).alias("q"))
    return q.select("page_id", F.inline(named_values(F.col("q"), "&")))


assert len(WEIGHTS) == len(duration.FEATURES) and not any(map(math.isnan, WEIGHTS))
