"""Queries over texts as they are read aloud and compared, beside the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import reading as R
from lexloom.plans.registry import query, table

BLANK = r"[\x09-\x0d\x20\xa0]+"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _number(p: str) -> str:
    padded, parts = f"lpad({p}, {R.DIGITS}, '0')", []
    for i, scale in enumerate(R.SCALES):
        h, t, o = (f"substr({padded}, {3 * i + k}, 1)" for k in (1, 2, 3))
        group = f"substr({padded}, {3 * i + 1}, 3)"
        one = f"({_list(R.ONES)})[{o}::INT + 1]"
        parts += [f"CASE WHEN {h} > '1' THEN ({_list(R.ONES)})[{h}::INT + 1] END", f"CASE WHEN {h} > '0' THEN 'yüz' END", f"({_list(R.TENS)})[{t}::INT + 1]", f"CASE WHEN {group} <> '001' THEN {one} END" if scale == "bin" else one, f"CASE WHEN {group} <> '000' THEN '{scale}' END"]
    return f"coalesce(nullif(array_to_string(list_filter([{', '.join(parts)}], lambda w: w IS NOT NULL AND w <> ''), ' '), ''), 'sıfır')"


def _numbers(text: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({text}, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]{{1,{R.DIGITS}}}$') THEN {_number('p')} ELSE p END), '')"


def _spaced(text: str) -> str:
    return f"trim(regexp_replace({text}, '{BLANK}', ' ', 'g'), ' ')"


def _spoken(text: str) -> str:
    out = rf"regexp_replace({text}, '%\s?([0-9]+)', 'yüzde \1', 'g')"
    for sign, name in R.SIGNS:
        out = rf"regexp_replace(regexp_replace({out}, '\Q{sign}\E ?([0-9]+)', '\1 {name}', 'g'), '([0-9]) ?\Q{sign}\E', '\1 {name}', 'g')"
    for unit, name in R.UNITS:
        out = rf"regexp_replace({out}, '([0-9]) ?{unit}\b', '\1 {name}', 'g')"
    for symbol, name in R.SYMBOLS:
        out = f"replace({out}, '{symbol}', ' {name} ')"
    return _spaced(_numbers(f"({out})"))


def _metric(text: str) -> str:
    return rf"trim(regexp_replace({_numbers(f"regexp_replace(lower(translate({text}, 'İI', 'iı')), '[''’]', '', 'g')")}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"


SAYABLE = R.SAYABLE.replace("'", "''")
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?…]+)([\x09-\x0d\x20]+|\z)', '\1' || chr(1), 'g'), chr(1)), lambda s: {_spaced('s')}), lambda s: s <> '')"
CAPTION = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]+>', ' ', 'g')"


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, {_numbers("(doc_id || ' ' || text)")} AS spoken FROM documents")
def number_words(spark, sf):
    """Every text, and its number in front, with all numbers in words."""
    return documents(spark, sf).select("doc_id", R.numbers_in_words(F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text")).alias("spoken"))


@query(f"SELECT doc_id, said, length(said)::INT AS n FROM (SELECT doc_id, {_spoken('text')} AS said FROM documents)")
def spoken_documents(spark, sf):
    """Every text as it is said: percentages, money, units, symbols and numbers by name."""
    return documents(spark, sf).select("doc_id", R.spoken(F.col("text")).alias("said")).withColumn("n", F.length("said"))


@query(f"SELECT doc_id, {_spaced(f"regexp_replace(said, '{SAYABLE}', ' ', 'g')")} AS said, len(regexp_extract_all(said, '{SAYABLE}'))::INT AS removed FROM (SELECT doc_id, {_spoken('text')} AS said FROM documents)")
def speakable_documents(spark, sf):
    """What a voice can read of it, and how many characters it cannot."""
    said, removed = R.speakable(F.col("text"))
    return documents(spark, sf).select("doc_id", said.alias("said"), removed.alias("removed"))


@query(f"SELECT doc_id, m AS metric, length(replace(m, ' ', ''))::INT AS characters FROM (SELECT doc_id, {_metric('text')} AS m FROM documents)")
def metric_documents(spark, sf):
    """The text in which errors are counted, and its characters without blanks."""
    d = documents(spark, sf).select("doc_id", R.metric_text(F.col("text")).alias("metric"))
    return d.withColumn("characters", F.length(F.replace("metric", F.lit(" "), F.lit(""))))


@query(f"""WITH k AS (SELECT doc_id, translate({_metric('text')}, 'ıâîû', 'iaiu') AS match_key FROM documents), h AS (SELECT DISTINCT translate({_metric('text')}, 'ıâîû', 'iaiu') AS match_key FROM benchmark)
SELECT doc_id, sha256(match_key) AS digest, match_key IN (SELECT match_key FROM h) AS held_out FROM k""")
def metric_keys(spark, sf):
    """The key in which texts are compared with held-out sentences, as a digest, and whether it is one of theirs."""
    held = table(spark, sf, "benchmark").select(R.match_key(F.col("text")).alias("match_key")).distinct().withColumn("held", F.lit(True))
    d = documents(spark, sf).select("doc_id", R.match_key(F.col("text")).alias("match_key")).join(held, "match_key", "left")
    return d.select("doc_id", F.sha2("match_key", 256).alias("digest"), F.coalesce("held", F.lit(False)).alias("held_out"))


@query(f"SELECT doc_id, (i - 1)::INT AS i, length(s[i])::INT AS n FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), range(1, 100000) t(i) WHERE i <= len(s)")
def sentence_split(spark, sf):
    """The sentences of every text and their lengths."""
    return documents(spark, sf).select("doc_id", F.posexplode(R.sentences(F.col("text"))).alias("i", "s")).select("doc_id", "i", F.length("s").alias("n"))


@query(f"""WITH e AS (SELECT doc_id, i, s[i] AS s FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), range(1, 100000) t(i) WHERE i <= len(s)),
p AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 180 AS chunk FROM e)
SELECT doc_id, chunk::BIGINT AS chunk, count(*) AS sentences, sha256(string_agg(s, ' ' ORDER BY i)) AS digest FROM p GROUP BY 1, 2""")
def sentence_chunks(spark, sf):
    """Whole sentences put together by the stretch of 180 characters in which they begin."""
    e = documents(spark, sf).select("doc_id", F.posexplode(R.sentences(F.col("text"))).alias("i", "s"))
    ahead = F.coalesce(F.sum(F.length("s") + 1).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = e.withColumn("chunk", F.floor(ahead / 180)).groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("rows"))
    return rows.select("doc_id", "chunk", F.size("rows").cast("long").alias("sentences"), F.sha2(F.array_join(F.transform("rows", lambda r: r["s"]), " "), 256).alias("digest"))


def _caption(text: str) -> str:
    for name, character in R.NAMED:
        text = f"replace({text}, '{name}', '{character.replace(chr(39), chr(39) * 2)}')"
    return _spaced(text)


@query(f"SELECT page_id, {_caption(CAPTION)} AS caption FROM pages")
def caption_clean(spark, sf):
    """A page's text without tags, with the named characters of hypertext and single blanks."""
    bare = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]+>", " ")
    return table(spark, sf, "pages").select("page_id", R.caption(bare).alias("caption"))


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT vec_id, x, list_transform(range(1, 33), lambda k: pow(list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * cos(k * i * 0.09817477042468103))), 2) + pow(list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * sin(k * i * 0.09817477042468103))), 2)) AS power FROM x)
SELECT vec_id, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS peak, round(sqrt(list_dot_product(x, x) / 64), 6) AS rms, len(list_filter(range(1, 64), lambda i: (x[i] < 0) <> (x[i + 1] < 0)))::INT AS crossings, list_position(power, list_max(power))::INT AS strongest,
len(power)::INT - list_position(list_reverse(list_transform(power, lambda v: v >= 0.1 * list_max(power))), true)::INT + 1 AS bandwidth FROM p""")
def signal_measures(spark, sf):
    """Vectors read as 64 samples: peak, level, sign changes, the strongest frequency, and the highest one within 10 dB of it."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    v = table(spark, sf, "embeddings").select("vec_id", x.alias("x"), R.spectrum(x, 64).alias("power")).withColumn("most", F.array_max("power"))
    crossings = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: (F.element_at("x", i) < 0) != (F.element_at("x", i + 1) < 0)), lambda c: c))
    last = F.size("power") - F.array_position(F.transform(F.reverse("power"), lambda p: p >= F.col("most") * 0.1), True).cast("int") + 1
    return v.select("vec_id", F.round(F.array_max(F.transform("x", F.abs)), 6).alias("peak"), F.round(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e) / 64), 6).alias("rms"), crossings.alias("crossings"), F.array_position("power", F.col("most")).cast("int").alias("strongest"), last.alias("bandwidth"))
