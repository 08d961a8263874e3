"""Arrays of samples, frames and tokens: levels, trims, pooling, padding, masks, negatives, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import arrays as A
from lexloom.functions.expr import byte_tokens, hash01, words
from lexloom.plans.curation import HASH
from lexloom.operators.vectors import partial_moments
from lexloom.plans.registry import query, table

D = "d AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)"
LEVELS = f"{D}, l AS (SELECT vec_id, a, list_transform(range(0, 8), lambda i: 20 * log10(sqrt(list_sum(list_transform(a[i * 8 + 1:i * 8 + 8], lambda x: x * x)) / 8) + 1e-9)) AS levels FROM d)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


@query(f"WITH {LEVELS} SELECT vec_id, list_transform(levels, lambda x: round(x, 6)) AS levels, round(greatest(list_max(levels) - 40.0, -60.0), 6)::DOUBLE AS threshold FROM l")
def frame_levels(spark, sf):
    """Levels of eight frames of eight samples, and what counts as loud."""
    v = vectors(spark, sf).select("vec_id", A.frame_levels(F.col("embedding"), 8).alias("levels"))
    return v.select("vec_id", F.transform("levels", lambda x: F.round(x, 6)).alias("levels"), F.round(A.loud_threshold(F.col("levels")), 6).alias("threshold"))


@query(f"""WITH {LEVELS}, t AS (SELECT vec_id, list_transform(levels, lambda x: x > greatest(list_max(levels) - 3.0, -60.0)) AS loud FROM l),
p AS (SELECT vec_id, list_position(loud, true) AS f, 9 - list_position(list_reverse(loud), true) AS z FROM t)
SELECT vec_id, greatest((f - 1) * 8 - 2, 0)::BIGINT AS start, least(z * 8 + 3, 64)::BIGINT AS "end" FROM p""")
def trim_silence(spark, sf):
    """What is within 3 dB of the loudest frame, with margins."""
    return vectors(spark, sf).select("vec_id", A.trim_bounds(F.col("embedding"), 8, 2, 3, 3.0).alias("t")).select("vec_id", "t.start", "t.end")


@query("""WITH f AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(list_transform(embedding, lambda x: x > 0)) AS loud FROM embeddings),
g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, loud ORDER BY i) AS k FROM f), r AS (SELECT vec_id, loud, min(i) AS s, max(i) + 1 AS e FROM g GROUP BY vec_id, loud, k),
p AS (SELECT vec_id, s, e, s - lag(e) OVER (PARTITION BY vec_id ORDER BY s) AS gap FROM r WHERE loud AND e - s >= 2)
SELECT vec_id, min(s) AS leading, 64 - max(e) AS trailing, count(*) FILTER (WHERE gap >= 3) AS pauses, coalesce(sum(gap) FILTER (WHERE gap >= 3), 0)::BIGINT AS pause_frames,
  (max(e) - min(s) - coalesce(sum(gap) FILTER (WHERE gap >= 3), 0))::BIGINT AS speech_frames FROM p GROUP BY vec_id""")
def speech_timing(spark, sf):
    """Runs of loud frames: those under two frames are dropped, gaps of three and more between the rest are pauses."""
    f = vectors(spark, sf).select("vec_id", F.posexplode(F.transform("embedding", lambda x: x > 0)).alias("i", "loud")).filter("loud")
    f = f.withColumn("k", F.col("i") - F.row_number().over(Window.partitionBy("vec_id").orderBy("i")))
    runs = f.groupBy("vec_id", "k").agg(F.min("i").alias("s"), (F.max("i") + 1).alias("e")).filter("e - s >= 2")
    gap = F.col("s") - F.lag("e").over(Window.partitionBy("vec_id").orderBy("s"))
    pause = F.when(F.col("gap") >= 3, F.col("gap"))
    out = runs.withColumn("gap", gap).groupBy("vec_id").agg(
        F.min("s").cast("long").alias("leading"), (F.lit(64) - F.max("e")).cast("long").alias("trailing"), F.count(pause).alias("pauses"),
        F.coalesce(F.sum(pause), F.lit(0)).alias("pause_frames"), (F.max("e") - F.min("s")).alias("span"),
    )
    return out.withColumn("speech_frames", (F.col("span") - F.col("pause_frames")).cast("long")).drop("span")


@query(f"WITH {D} SELECT vec_id, list_transform(range(0, 16), lambda i: list_sum(a[i * 4 + 1:i * 4 + 4]) / 4) AS pooled FROM d")
def pool_frames(spark, sf):
    return vectors(spark, sf).select("vec_id", A.pooled(F.col("embedding"), 4, F.lit(16)).alias("pooled"))


@query("SELECT event_id, coalesce(CASE WHEN NOT isnan((value - 3.0) / 0.5) THEN (value - 3.0) / 0.5 END, 0.0)::DOUBLE AS feature FROM events")
def quality_features(spark, sf):
    return table(spark, sf, "events").select("event_id", A.quality_feature(F.col("value")).alias("feature"))


@query("""WITH f AS (SELECT event_id, CASE WHEN value < 10 THEN round_even(value * 1000, 0) ELSE round_even(value, 0) END::INT AS k FROM events)
SELECT event_id, CASE WHEN k BETWEEN 500 AND 2000 THEN k END AS tempo FROM f""")
def tempo_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", A.tempo_key(F.col("value")).alias("tempo"))


@query("SELECT doc_id, (n_chars + 63) // 64 * 64 AS cost FROM documents")
def padded_costs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.padded_cost(F.col("n_chars"), 64).alias("cost"))


@query(f"""WITH {D}, c AS (SELECT vec_id, a, (vec_id % 64)::INT AS cut FROM d), i AS (SELECT *, unnest(range(greatest(cut - 4, 0), least(cut + 2, 62) + 1)) AS i FROM c WHERE cut >= 1),
b AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY (a[i + 1] - 0.0) ** 2, abs(i - cut + 1), i) AS k FROM i)
SELECT c.vec_id, coalesce(b.i + 1, cut)::INT AS cut FROM c LEFT JOIN b ON b.vec_id = c.vec_id AND k = 1""")
def quiet_cuts(spark, sf):
    """A cut moved to the frame nearest silence within three frames."""
    cut = F.pmod("vec_id", F.lit(64)).cast("int")
    return vectors(spark, sf).select("vec_id", A.quiet_cut(F.col("embedding"), cut, 0.0, 3).alias("cut"))


WORD_SIZES = r"w AS (SELECT conv_id, turn, list_transform(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> ''), lambda x: length(x)) AS a FROM conversations)"


def word_sizes(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.transform(words(F.col("text")), lambda w: F.length(w).cast("long")).alias("a"))


@query(f"""WITH {WORD_SIZES}, m AS (SELECT *, max(len(a)) OVER (PARTITION BY conv_id) AS n FROM w)
SELECT conv_id, turn, list_resize(a, n, 0) AS values, list_resize(list_transform(a, lambda x: true), n, false) AS valid FROM m""")
def collate(spark, sf):
    """Arrays padded to the longest of their batch, and the mask of what is real; the longest is one number a batch, joined back."""
    w = word_sizes(spark, sf)
    n = w.groupBy("conv_id").agg(F.max(F.size("a")).alias("n"))
    return w.join(n, "conv_id").select("conv_id", "turn", A.padded(F.col("a"), F.col("n"), F.lit(0).cast("long")).alias("values"), A.valid_mask(F.size("a"), F.col("n")).alias("valid"))


@query(f"WITH {WORD_SIZES} SELECT conv_id, turn, list_resize(a, (len(a) + 7) // 8 * 8, 0) AS values FROM w")
def pad_to_multiple(spark, sf):
    return word_sizes(spark, sf).select("conv_id", "turn", A.padded(F.col("a"), A.padded_cost(F.size("a"), 8).cast("int"), F.lit(0).cast("long")).alias("values"))


@query("""WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x > -0.15) AS v, list_transform(embedding, lambda x: x > 0.1) AS r0, (vec_id % 3) AS kind, len(embedding) AS k FROM embeddings),
n AS (SELECT vec_id, k, CASE WHEN kind = 0 THEN v ELSE list_transform(range(0, k), lambda i: i < k // 2) END AS v, CASE WHEN kind = 1 THEN r0 WHEN kind = 2 THEN list_transform(range(0, k), lambda i: i < 1 + vec_id % 40) ELSE list_transform(r0, lambda x: false) END AS r FROM m)
SELECT vec_id, CASE WHEN list_bool_or(list_transform(range(1, k + 1), lambda i: r[i] AND NOT v[i])) THEN 'reference outside valid' WHEN list_bool_or(list_transform(range(1, k), lambda i: NOT v[i] AND v[i + 1])) THEN 'valid is no prefix'
WHEN NOT list_bool_or(list_transform(range(1, k + 1), lambda i: v[i] AND NOT r[i])) THEN 'no target' END AS violation FROM n""")
def mask_contract(spark, sf):
    """Masks that break a rule: reference frames are valid ones, valid frames a prefix, and one target frame is left."""
    kind, k = F.pmod("vec_id", F.lit(3)), F.size("embedding")
    v = F.when(kind == 0, F.transform("embedding", lambda x: x.cast("double") > -0.15)).otherwise(F.transform("embedding", lambda x, i: i < F.floor(k / 2)))
    r = F.when(kind == 1, F.transform("embedding", lambda x: x.cast("double") > 0.1)).otherwise(F.transform("embedding", lambda x, i: (kind == 2) & (i < 1 + F.pmod("vec_id", F.lit(40)))))
    return vectors(spark, sf).select("vec_id", v.alias("v"), r.alias("r")).select("vec_id", A.mask_violation(F.col("v"), F.col("r")).alias("violation"))


@query(f"""WITH {WORD_SIZES}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM w)
SELECT o.conv_id, o.turn, o.n > 1 AS usable, CASE WHEN o.n > 1 THEN list_resize(p.a, len(o.a), coalesce(p.a[len(p.a)], 0)) ELSE o.a END AS negative FROM o JOIN o p ON o.conv_id = p.conv_id AND p.i = (o.i + o.n - 1) % o.n""")
def random_negatives(spark, sf):
    """Each row's target replaced by that of the row before it in its batch (the first takes the last's), cut or padded to its own length."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = word_sizes(spark, sf).withColumn("before", F.lag("a").over(w))
    last = rows.groupBy("conv_id").agg(F.max_by("a", "turn").alias("last"), (F.count("*") > 1).alias("usable"))
    partner = F.coalesce("before", "last")
    tail = F.coalesce(F.try_element_at(partner, F.lit(-1)), F.lit(0))
    return rows.join(last, "conv_id").select("conv_id", "turn", "usable", F.when(F.col("usable"), A.resized(partner, F.size("a"), tail)).otherwise(F.col("a")).alias("negative"))


SPAN = f"""WITH {WORD_SIZES}, u AS (SELECT *, {HASH.format("'12:' || conv_id || ':' || turn")} AS u, {HASH.format("'13:' || conv_id || ':' || turn")} AS v FROM w WHERE len(a) >= 4),
s AS (SELECT *, greatest(len(a) // 4, 1) AS n FROM u), k AS (SELECT *, floor(u * (len(a) - n + 1))::BIGINT AS p FROM s), q AS (SELECT *, (p + 1 + floor(v * (len(a) - n))::BIGINT) % (len(a) - n + 1) AS src FROM k)"""


@query(f"""{SPAN} SELECT conv_id, turn, list_concat(list_concat(a[1:p], a[src + 1:src + n]), a[p + n + 1:]) AS repeated,
list_concat(list_concat(a[1:p], a[p + n + 1:]), list_transform(range(0, n), lambda i: 0::BIGINT)) AS skipped FROM q""")
def span_edits(spark, sf):
    """A quarter of the words overwritten by another stretch, or taken out; where, is drawn by a hash."""
    key = (F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    w = word_sizes(spark, sf).filter(F.size("a") >= 4).withColumn("n", F.greatest(F.floor(F.size("a") / 4).cast("int"), F.lit(1)))
    w = w.withColumn("at", F.floor(hash01(F.lit("12"), *key) * (F.size("a") - F.col("n") + 1)).cast("int"))
    w = w.withColumn("src", F.pmod(F.col("at") + 1 + F.floor(hash01(F.lit("13"), *key) * (F.size("a") - F.col("n"))).cast("int"), F.size("a") - F.col("n") + 1))
    a, at, src, n = (F.col(c) for c in ("a", "at", "src", "n"))
    return w.select("conv_id", "turn", A.repeated_span(a, at, src, n).alias("repeated"), A.skipped_span(a, at, n, F.lit(0).cast("long")).alias("skipped"))


@query("SELECT vec_id, list_transform(embedding[vec_id % 40 + 1:vec_id % 40 + 20], lambda x: x::DOUBLE) AS frames FROM embeddings")
def teacher_slice(spark, sf):
    """A side store's frames cut as the main ones are."""
    at = F.pmod("vec_id", F.lit(40)).cast("int")
    return vectors(spark, sf).select("vec_id", A.doubles(F.slice("embedding", at + 1, 20)).alias("frames"))


@query("""WITH e AS (SELECT embedding AS v, len(embedding) AS k FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT a.i, b.j, v[a.i + 1]::DOUBLE AS x, v[b.j + 1]::DOUBLE AS y FROM e, range(0, 64) a(i), range(0, 64) b(j) WHERE a.i <= b.j AND b.j < k)
SELECT i::INT AS i, j::INT AS j, round(sum(x * y), 6) AS product, round(sum(x), 6) AS total, count(*) AS n FROM p GROUP BY 1, 2""")
def second_moments(spark, sf):
    """Sums and products that a principal component analysis needs, of every pair of dimensions: each partition adds up its own matrix, the shuffle joins them."""
    sums = partial_moments(vectors(spark, sf), "embedding").groupBy("i", "j").agg(F.sum("product").alias("product"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select("i", "j", F.round("product", 6).alias("product"), F.round("total", 6).alias("total"), "n")


BODY = "list_transform(range(0, strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), i * 2 + 1, 2))::INT + 4)"


@query(f"""WITH p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r, text AS t FROM conversations), b AS (SELECT conv_id, turn, {BODY.format('r')} AS r, {BODY.format('t')} AS t FROM p WHERE r IS NOT NULL)
SELECT conv_id, turn, list_concat([1], list_concat(r, list_concat([2], list_concat(t, [3])))) AS segmented, list_concat(list_transform(range(0, len(r) + 2), lambda i: 0), list_transform(range(0, len(t) + 1), lambda i: 1)) AS marks,
list_concat([1], list_concat(r, list_concat([36], list_concat(t, [3])))) AS joined FROM b""")
def token_layouts(spark, sf):
    """A turn after the one before it: kept apart by a mark with segment numbers, or joined into one stream."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before")).filter("before is not null")
    c = c.select("conv_id", "turn", *(byte_tokens(F.col(x), 4, 1, 3).alias(n) for x, n in (("before", "r"), ("text", "t"))))
    s, j = A.assembled(F.col("r"), F.col("t")), A.joined_ids(F.array("r", "t"))
    return c.select("conv_id", "turn", s["tokens"].alias("segmented"), s["segments"].alias("marks"), j.alias("joined"))


CTC = "trim(regexp_replace(regexp_replace(translate(regexp_replace(lower(translate(text, 'İI', 'iı')), '[''’]', '', 'g'), 'âîû', 'aiu'), '[^abcdefghijklmnopqrstuvwxyzçğıöşü]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH c AS (SELECT conv_id, turn, {CTC} AS t FROM conversations) SELECT conv_id, turn, t AS spoken, list_transform(range(1, length(t) + 1), lambda i: strpos(' abcdefghijklmnopqrstuvwxyzçğıöşü', substr(t, i, 1))) AS labels FROM c""")
def alignment_targets(spark, sf):
    """Letters for the alignment loss, and their labels."""
    return table(spark, sf, "conversations").select("conv_id", "turn", A.alignment_text(F.col("text")).alias("spoken")).withColumn("labels", A.alignment_labels(F.col("spoken")))


@query(rf"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations), u AS (SELECT *, floor({HASH.format("'14:' || conv_id || ':' || turn")} * len(w))::BIGINT AS i, {HASH.format("'15:' || conv_id || ':' || turn")} < 0.5 AS skip FROM w WHERE len(w) >= 2)
SELECT conv_id, turn, array_to_string(CASE WHEN skip THEN list_concat(w[1:i], w[i + 2:]) ELSE list_concat(w[1:i + 1], w[i + 1:]) END, ' ') AS corrupted FROM u""")
def corrupt_transcripts(spark, sf):
    """One word skipped or said twice, which one is drawn by a hash."""
    key = (F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", words(F.col("text")).alias("w")).filter(F.size("w") >= 2)
    c = c.withColumn("i", F.floor(hash01(F.lit("14"), *key) * F.size("w")).cast("int"))
    out = F.when(hash01(F.lit("15"), *key) < 0.5, A.without_word(F.col("w"), F.col("i"))).otherwise(A.word_twice(F.col("w"), F.col("i")))
    return c.select("conv_id", "turn", F.array_join(out, " ").alias("corrupted"))
