"""Text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.alignment import word_edits
from lexloom.functions.expr import ascii_metric_text, ngrams, pause_seconds, text_units, tr_lower, tr_upper, word_distance, words
from lexloom.plans.curation import KEY, NGRAMS
from lexloom.plans.registry import query, table


@query("SELECT doc_id, lower(translate(text, 'İI', 'iı')) AS folded FROM documents")
def tr_case(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tr_lower(F.col("text")).alias("folded"))


@query("SELECT doc_id, upper(translate(left(source, 3) || lang, 'iı', 'İI')) AS capitals, upper(translate(left(lang, 1), 'iı', 'İI')) || lower(translate(substr(lang, 2), 'İI', 'iı')) AS titled, upper(translate(text, 'iıß', 'İI')) AS shouted FROM documents")
def tr_upper_and_title(spark, sf):
    lang = F.col("lang")
    return table(spark, sf, "documents").select("doc_id", tr_upper(F.concat(F.substring("source", 1, 3), lang)).alias("capitals"), F.concat(tr_upper(F.substring(lang, 1, 1)), tr_lower(F.substring(lang, 2, 1 << 20))).alias("titled"), tr_upper(F.translate("text", "ß", "")).alias("shouted"))


@query(f"SELECT doc_id, {KEY.format('text')} AS metric FROM documents")
def ascii_metric(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ascii_metric_text(F.col("text")).alias("metric"))


@query(f"WITH t AS (SELECT doc_id, list_filter(string_split({KEY.format('text')}, ' '), lambda x: x <> '') AS w FROM documents) SELECT doc_id, list_sort({NGRAMS}) AS grams FROM t")
def ngram_set(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sort_array(ngrams(words(ascii_metric_text(F.col("text"))), 3)).alias("grams"))


@query(r"""SELECT doc_id, strlen(text) AS n_bytes, length(text) AS n_code_points, len(regexp_extract_all(text, '[aeıioöuüâîû]')) AS syllables,
len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n_words, len(regexp_extract_all(text, '[,;:-]')) AS commas, len(regexp_extract_all(text, '[.!?]+')) AS stops FROM documents""")
def text_unit_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *(c.alias(k) for k, c in text_units(F.col("text")).items()))


@query(r"""WITH b AS (SELECT item_id, regexp_replace(text, '[\s.!?,;:…"''»”’)\]-]+$', '') AS b FROM benchmark) SELECT item_id, len(regexp_extract_all(b, '[,;:]|\s-\s')) * 0.15::DOUBLE + len(regexp_extract_all(b, '[.!?…]+')) * 0.3::DOUBLE AS seconds FROM b""")
def pause_budget(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", pause_seconds(F.col("text")).alias("seconds"))


NEXT = "n AS (SELECT conv_id, turn, text AS r, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations)"


def _next(spark, sf):

    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("r"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("h")).filter("h is not null")


@query(f"WITH {NEXT} SELECT conv_id, turn, levenshtein({KEY.format('r')}, {KEY.format('h')}) AS edits FROM n WHERE h IS NOT NULL")
def char_levenshtein(spark, sf):
    """Edits between whole turns."""
    return _next(spark, sf).select("conv_id", "turn", F.levenshtein(ascii_metric_text(F.col("r")), ascii_metric_text(F.col("h"))).cast("long").alias("edits"))


@query()
def cer_wer(spark, sf):
    """Corpus rates of each conversation's turn against the next: word and character edits over the reference."""
    x = _next(spark, sf).select("conv_id", ascii_metric_text(F.col("r")).alias("r"), ascii_metric_text(F.col("h")).alias("h")).filter("r != ''")
    rw, hw = words(F.col("r")), words(F.col("h"))
    x = x.select("conv_id", word_distance(rw, hw).alias("we"), F.size(rw).alias("w"), F.levenshtein(F.replace("r", F.lit(" "), F.lit("")), F.replace("h", F.lit(" "), F.lit(""))).alias("ce"), F.length(F.replace("r", F.lit(" "), F.lit(""))).alias("c"))
    return x.groupBy("conv_id").agg((F.sum("we") / F.sum("w")).alias("wer"), (F.sum("ce") / F.sum("c")).alias("cer"), F.count("*").alias("n"))


@query()
def word_edit_kinds(spark, sf):
    """Substituted, deleted and inserted words from each turn to the next, by role, with the corpus rate."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", ascii_metric_text(F.col("text")).alias("text"))
    c = c.select("role", "text", F.lead("text").over(w).alias("h")).filter("h is not null").select("role", words(F.col("text")).alias("r"), words(F.col("h")).alias("h"))
    e = c.select("role", F.size("r").alias("words"), word_edits(F.col("r"), F.col("h")).alias("e"))
    sums = e.groupBy("role").agg(F.sum("words").alias("words"), *(F.sum(f"e.{k}").alias(k) for k in ("substitutions", "deletions", "insertions")))
    return sums.withColumn("wer", (F.col("substitutions") + F.col("deletions") + F.col("insertions")) / F.col("words"))
