"""Split maps, held-out checks, cases and pairs, audits as one report, ordered and shuffled scans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.expr import hash01, split_of
from lexloom.functions import reading as R
from lexloom.functions.specs import split_key
from lexloom.operators import splits as S
from lexloom.operators.cases import greedy_cases
from lexloom.operators.curate import quota
from lexloom.operators.order import places
from lexloom.operators.prepare import side_store
from lexloom.operators.ranges import checked_overlaps
from lexloom.plans.curation import HASH, SPLIT
from lexloom.plans.reading import _spoken
from lexloom.plans.registry import query, table

SPLIT_OF = "CASE WHEN {0} < 0.01 THEN 'test' WHEN {0} < 0.02 THEN 'val' ELSE 'train' END"
LABELS = "s AS (SELECT s_suppkey AS label, s_nationkey AS key, s_suppkey // 7 AS cluster, CASE WHEN s_suppkey % 9 = 0 THEN 'train' WHEN s_suppkey % 2 = 0 THEN 'val' ELSE 'test' END AS split, 1 + s_suppkey % 4 AS n FROM supplier)"
GROUPS = f"""{LABELS}, e AS (SELECT a.label AS x, b.label AS y FROM s a JOIN s b ON a.key = b.key AND a.key < 6 UNION SELECT a.label, b.label FROM s a JOIN s b ON a.cluster = b.cluster),
r(label, reach) AS (SELECT label, label FROM s UNION SELECT r.label, e.y FROM r JOIN e ON e.x = r.reach), g AS (SELECT label, min('' || reach) AS grp FROM r GROUP BY 1)"""


def labels(spark, sf):
    s = table(spark, sf, "supplier")
    split = F.when(F.col("s_suppkey") % 9 == 0, "train").when(F.col("s_suppkey") % 2 == 0, "val").otherwise("test")
    return s.select(F.col("s_suppkey").alias("label"), F.when(F.col("s_nationkey") < 6, F.col("s_nationkey")).alias("key"), F.floor(F.col("s_suppkey") / 7).alias("cluster"), split.alias("split"), (1 + F.col("s_suppkey") % 4).alias("n"))


@query(f"""WITH RECURSIVE {GROUPS}, m AS (SELECT grp, CASE WHEN max((split = 'train')::INT) = 1 THEN 'train' WHEN sum(CASE WHEN split = 'test' THEN n ELSE 0 END) >= sum(CASE WHEN split = 'val' THEN n ELSE 0 END) THEN 'test' ELSE 'val' END AS mapped FROM s JOIN g USING (label) GROUP BY 1)
SELECT '' || label AS label, mapped FROM g JOIN m USING (grp)""")
def split_map_clusters(spark, sf):
    """One split for all labels joined by a cluster or a key; train is kept."""
    return S.split_map(labels(spark, sf), "label", "split", "n", ("cluster", "key"))


@query(f"""WITH RECURSIVE {GROUPS}, m AS (SELECT grp, min(CASE WHEN key < 6 THEN '' || key ELSE '' || label END) AS k FROM s JOIN g USING (label) GROUP BY 1)
SELECT '' || label AS label, {SPLIT_OF.format(HASH.format("'0:' || k"))} AS mapped FROM g JOIN m USING (grp)""")
def split_map_hash(spark, sf):
    """The same groups, each split afresh by the hash of its least key."""
    return S.split_map(labels(spark, sf), "label", "split", "n", ("cluster", "key"), "hash")


@query(f"""WITH h AS (SELECT doc_id, source FROM documents WHERE {SPLIT} <> 'train'), t AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id FROM t WHERE doc_id IN (SELECT doc_id FROM h) UNION SELECT doc_id FROM t WHERE source IN (SELECT source FROM h WHERE doc_id % 3 = 0)""")
def held_out_rows(spark, sf):
    """Training rows of one catalogue that another holds out, by id or by speaker."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    held = d.filter(split_of(F.col("doc_id")) != "train")
    # speakers of a third of the held-out rows count as held out here
    held = held.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"))
    return S.not_held_out(d.filter("doc_id % 2 = 0"), held, "doc_id", "source").select("doc_id")


@query(r"SELECT page_id, regexp_extract(url, '://([^/?#:]*)', 1) AS key FROM pages WHERE contains(url, '://')")
def split_key_group(spark, sf):
    """The group named key of a pattern; a row that does not match would be an error."""
    pages = table(spark, sf, "pages").filter(F.col("url").contains("://"))
    return pages.select("page_id", split_key(F.col("url"), r"://(?P<key>[^/?#:]*)").alias("key"))


@query()
def make_cases(spark, sf):
    """Pairs of one speaker without reuse of a recording or its content, across sessions."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), (F.col("doc_id") % 7).cast("string").alias("session"))
    return greedy_cases(d, "source", "doc_id", "digest", 3, session="session")


@query(f"""WITH h AS (SELECT source, doc_id, {HASH.format("'4:' || doc_id")} AS h FROM documents), k AS (SELECT *, row_number() OVER w AS k, lead(doc_id) OVER w AS nx, count(*) OVER (PARTITION BY source) AS n, first_value(doc_id) OVER w AS head FROM h WINDOW w AS (PARTITION BY source ORDER BY h, doc_id))
SELECT source, doc_id, coalesce(nx, head) AS prompt FROM k WHERE n > 1 ORDER BY k, {HASH.format("'4:' || source")}, source LIMIT 50""")
def round_robin_pairs(spark, sf):
    """Fifty targets taken from the speakers in turn, each once."""
    return S.round_robin(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 50, 4)


@query("""WITH c AS (SELECT a.doc_id AS target, b.doc_id AS reference FROM labels a JOIN labels b ON a.quality = b.quality AND a.toxic = b.toxic AND a.doc_id < b.doc_id AND a.doc_id % 4 <> b.doc_id % 4 AND b.doc_id - a.doc_id <= 12) SELECT * FROM c""")
def cross_session_pairs(spark, sf):
    """Pairs of equal labels from different sessions, among neighbours: buckets of the distance make it an equi-join."""
    x = table(spark, sf, "labels").withColumn("b", F.floor(F.col("doc_id") / 12))
    y = x.select(F.col("doc_id").alias("reference"), "quality", "toxic", F.explode(F.array(F.col("b"), F.col("b") - 1)).alias("b"))
    pairs = x.join(y, ["b", "quality", "toxic"]).filter("doc_id < reference and doc_id % 4 <> reference % 4 and reference - doc_id <= 12")
    return pairs.select(F.col("doc_id").alias("target"), "reference").distinct()


SPAN = "e AS (SELECT user_id, event_id, epoch(ts) AS s, epoch(ts) + 3600 * floor(value) AS f FROM events)"


@query(f"""WITH RECURSIVE {SPAN}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f, event_id) AS k FROM e), g(user_id, k, last, taken) AS (SELECT DISTINCT user_id, 0::BIGINT, -1e18::DOUBLE, []::BIGINT[] FROM o UNION ALL
SELECT g.user_id, o.k, CASE WHEN o.s >= g.last THEN o.f ELSE g.last END, CASE WHEN o.s >= g.last THEN list_append(g.taken, o.event_id) ELSE g.taken END FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1)
SELECT user_id, max_by(taken, k) AS taken FROM g GROUP BY 1""")
def free_of_conflict(spark, sf):
    """Intervals that conflict with none chosen before them, by their ends; one recording's intervals fold inside a row."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events").select("user_id", F.struct((start + 3600 * F.floor("value")).alias("f"), F.col("event_id").alias("id"), start.alias("s")).alias("x"))
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list("x")).alias("rows"))
    zero = F.struct(F.lit(-1e18).alias("last"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc, x):
        ok = x["s"] >= acc["last"]
        return F.struct(F.when(ok, x["f"]).otherwise(acc["last"]).alias("last"), F.when(ok, F.concat(acc["taken"], F.array(x["id"]))).otherwise(acc["taken"]).alias("taken"))

    return rows.select("user_id", F.aggregate("rows", zero, step)["taken"].alias("taken"))


@query(f"""WITH {SPAN.replace('FROM events', 'FROM events WHERE floor(value) > 0')}, c AS (SELECT user_id, greatest(s - (SELECT min(epoch(ts)) FROM events) - 86400, 0) AS s, least(f - (SELECT min(epoch(ts)) FROM events) - 86400, 604800.0) AS f FROM e), v AS (SELECT * FROM c WHERE f > s),
m AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v), i AS (SELECT *, sum((r IS NULL OR s > r)::INT) OVER (PARTITION BY user_id ORDER BY s, f) AS k FROM m),
u AS (SELECT user_id, max(f) - min(s) AS n FROM i GROUP BY user_id, k) SELECT user_id, round(sum(n) / 604800.0, 9) AS ratio FROM u GROUP BY 1""")
def clipped_union_ratio(spark, sf):
    """Share of a range that intervals cover together, clipped to the range."""
    from lexloom.operators.ranges import islands

    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events")
    zero = F.broadcast(e.agg(F.min(start).alias("zero")))
    x = e.filter("floor(value) > 0").crossJoin(zero).select("user_id", F.greatest(start - F.col("zero") - 86400, F.lit(0.0)).alias("s"), F.least(start + 3600 * F.floor("value") - F.col("zero") - 86400, F.lit(604800.0)).alias("e")).filter("e > s")
    return islands(x, "user_id", "s", "e").groupBy("user_id").agg(F.round(F.sum(F.col("e") - F.col("s")) / 604800.0, 9).alias("ratio"))


@query(f"""WITH d AS (SELECT doc_id, source, {SPLIT} AS split, sha256(coalesce(text, '')) AS digest, n_chars FROM documents), l AS (SELECT source FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1), g AS (SELECT digest, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1),
v AS (SELECT user_id, event_id, CASE WHEN event_id % 83 = 0 THEN -1.0 WHEN event_id % 89 = 0 THEN 'nan'::DOUBLE ELSE epoch(ts) END AS s, epoch(ts) + 3600 * floor(value) AS e FROM events),
w AS (SELECT *, coalesce(isfinite(s) AND isfinite(e) AND s >= 0 AND e > s, false) AS ok FROM v)
SELECT 'rows' AS finding, count(*)::BIGINT AS n FROM d UNION ALL SELECT 'broken_intervals', count(*) FROM w WHERE NOT ok UNION ALL SELECT 'overlapping_pairs', count(*) FROM w a JOIN w b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e AND a.ok AND b.ok UNION ALL SELECT 'speakers', count(DISTINCT source) FROM d UNION ALL SELECT 'speakers_across_splits', count(*) FROM l UNION ALL SELECT 'duplicate_groups', count(*) FROM g
UNION ALL SELECT 'duplicate_rows', coalesce(sum(n), 0)::BIGINT FROM g UNION ALL SELECT 'invalid_intervals', count(*) FROM d WHERE n_chars IS NULL OR n_chars <= 0 OR n_chars % 97 = 0 UNION ALL SELECT 'unlabelled', count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def audit_report(spark, sf):
    """One report: rows, speakers, leakage across splits, duplicates, invalid lengths, rows without a label, broken intervals of recordings and pairs that overlap."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", split_of(F.col("doc_id")).alias("split"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    bad = F.col("n_chars").isNull() | (F.col("n_chars") <= 0) | (F.col("n_chars") % 97 == 0)
    lone = d.join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    one = lone.agg(F.count("*").alias("rows"), F.count_distinct("source").alias("speakers"), F.count_if(bad).alias("invalid_intervals"), F.count_if(F.col("has").isNull()).alias("unlabelled"))
    across = d.groupBy("source").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("speakers_across_splits"))
    twice = d.groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1").agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("k"), F.lit(0)).alias("duplicate_rows"))
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    s = F.when(F.col("event_id") % 83 == 0, -1.0).when(F.col("event_id") % 89 == 0, float("nan")).otherwise(start)
    broken, pairs = checked_overlaps(table(spark, sf, "events").select("user_id", "event_id", s.alias("s"), (start + 3600 * F.floor("value")).alias("e")), "user_id", "event_id", "s", "e", 24 * 3600.0)
    row = one.crossJoin(across).crossJoin(twice).crossJoin(broken.agg(F.count("*").alias("broken_intervals"))).crossJoin(pairs.agg(F.count("*").alias("overlapping_pairs")))  # one row each
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("finding"), F.col(c).cast("bigint").alias("n")) for c in row.columns))))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {HASH.format("'21:' || doc_id")}, doc_id) - 1 AS place FROM documents")
def shuffled_places(spark, sf):
    """A seeded permutation: each row's place in the order of a hash."""
    d = table(spark, sf, "documents").select("doc_id", hash01(F.lit("21"), F.col("doc_id").cast("string")).alias("h"))
    return places(d, "h", "doc_id").select("doc_id", "place")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn, length(text)) - 1 AS place, length(text) AS n FROM conversations")
def ordered_map(spark, sf):
    """A parallel map whose results keep the order of their rows: places come from sampled ranges of the key."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return places(c, "conv_id", "turn", "n")


@query("""WITH m AS (SELECT doc_id % 3 AS part, string_agg(DISTINCT lang, '/' ORDER BY lang) || ':' || (max(n_chars) // 100000) AS version, count(*) AS n FROM documents GROUP BY 1) SELECT part, version, n, count(DISTINCT version) OVER () = 1 AS compatible FROM m""".replace("count(DISTINCT version) OVER () = 1", "(SELECT count(DISTINCT version) FROM m) = 1"))
def compatible_partitions(spark, sf):
    """Partitions with what they hold (languages, size class of the longest text); they may be united only if that is equal."""
    m = table(spark, sf, "documents").groupBy((F.col("doc_id") % 3).alias("part")).agg(F.count("*").alias("n"), F.concat_ws(":", F.array_join(F.array_sort(F.collect_set("lang")), "/"), F.floor(F.max("n_chars") / 100000).cast("string")).alias("version"))
    kinds = m.agg((F.count_distinct("version") == 1).alias("compatible"))
    return m.crossJoin(kinds).select("part", "version", "n", "compatible")


@query(f"""WITH h AS (SELECT conv_id, turn, {HASH.format("'5:' || conv_id || ':' || turn")} AS h FROM conversations), k AS (SELECT *, lead(turn) OVER w AS nx, first_value(turn) OVER w AS head FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY h, turn))
SELECT conv_id, turn, coalesce(nx, head) AS partner FROM k WHERE coalesce(nx, head) <> turn""")
def circular_partners(spark, sf):
    """Another row of the same group: the next one in a seeded order."""
    return S.circular_partner(table(spark, sf, "conversations"), "conv_id", "turn", 5)


@query(f"""WITH e AS (SELECT source, doc_id, epoch, {HASH.format("'31:' || epoch || ':' || doc_id")} AS u, {HASH.format("'32:' || epoch || ':' || doc_id")} AS v FROM documents, range(0, 2) t(epoch)),
h AS (SELECT source, doc_id, epoch, {HASH.format("epoch || ':' || source || ':' || doc_id")} AS h FROM documents, range(0, 2) t(epoch)),
k AS (SELECT *, lead(doc_id) OVER w AS nx, first_value(doc_id) OVER w AS head FROM h WINDOW w AS (PARTITION BY epoch, source ORDER BY h, doc_id)),
c AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents)
SELECT e.doc_id, epoch, u < 0.3 AS crossed, CASE WHEN u < 0.3 THEN nullif(coalesce(nx, head), e.doc_id) END AS partner, CASE WHEN v < 0.25 THEN 900 WHEN v < 0.75 THEN 1000 ELSE 1100 END AS tempo, floor(u * 10)::BIGINT AS tail_frames,
CASE WHEN v >= 0.5 THEN before END AS context FROM e JOIN k USING (doc_id, epoch) JOIN c USING (doc_id)""")
def epoch_plan(spark, sf):
    """What each row gets in each epoch, as a pure function of seed, epoch and row: whether its prompt is crossed and with which other row of its source, tempo, tail silence, and the row before it as context."""
    e = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("epoch"))
    u, v = (hash01(F.lit(s), F.col("epoch").cast("string"), F.col("doc_id").cast("string")) for s in ("31", "32"))
    d = table(spark, sf, "documents").select("doc_id", "source")
    partners = [S.circular_partner(d, "source", "doc_id", k).select("doc_id", "partner", F.lit(k).cast("long").alias("epoch")) for k in range(2)]
    before = S.previous(d, "source", "doc_id").select("doc_id", "before")
    e = e.join(partners[0].unionByName(partners[1]), ["doc_id", "epoch"], "left").join(before, "doc_id")
    return e.select(
        "doc_id", "epoch", (u < 0.3).alias("crossed"), F.when(u < 0.3, F.col("partner")).alias("partner"), F.when(v < 0.25, 900).when(v < 0.75, 1000).otherwise(1100).alias("tempo"), F.floor(u * 10).alias("tail_frames"),
        F.when(v >= 0.5, F.col("before")).alias("context"),
    )


@query("""WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations WHERE length(text) BETWEEN 40 AND 900 AND NOT regexp_matches(text, '\\d')),
x AS (SELECT * FROM p WHERE k = 1 AND text NOT IN (SELECT text FROM benchmark)), q AS (SELECT *, (conv_id % 7 = 0)::INT AS gender, row_number() OVER (PARTITION BY conv_id % 7 = 0 ORDER BY length(text) DESC, conv_id) AS r FROM x)
SELECT conv_id, turn, gender FROM q ORDER BY r > 20, length(text) DESC, conv_id LIMIT 40""")
def prompt_set(spark, sf):
    """Prompts of bounded length without digits or held-out text: the longest of each speaker, then an equal number of each gender, with the other one where one has too few."""
    c = table(spark, sf, "conversations").withColumn("n", F.length("text")).filter(F.col("n").between(40, 900) & ~F.col("text").rlike(r"\d"))
    best = c.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text", "n"), F.struct("n", -F.col("turn"))).alias("b")).select("conv_id", "b.*")
    free = best.join(table(spark, sf, "benchmark").select("text"), "text", "left_anti").withColumn("gender", (F.col("conv_id") % 7 == 0).cast("int"))
    return quota(free, "gender", [F.desc("n"), "conv_id"], 20, 40).select("conv_id", "turn", "gender")


@query("""WITH s AS (SELECT vec_id, label, vec_id % 3 AS part FROM embeddings WHERE vec_id % 17 <> 3), w AS (SELECT vec_id, t.tempo FROM embeddings, (VALUES (900), (1000)) t(tempo)), u AS (SELECT vec_id, part, 'part-' || part || '/' || vec_id AS path FROM s)
SELECT w.vec_id, w.tempo, u.path FROM w LEFT JOIN u USING (vec_id)""")
def merged_side_store(spark, sf):
    """Parts of a side store united with their paths, against all keys of the split; what is missing has no path."""
    v = table(spark, sf, "embeddings")
    parts = [v.filter((F.col("vec_id") % 3 == p) & (F.col("vec_id") % 17 != 3)).select("vec_id", F.concat(F.lit(f"part-{p}/"), F.col("vec_id").cast("string")).alias("path")) for p in range(3)]
    metas = [{"complete": True, "partition": p, "partitions": 3, "source": "embeddings", "dims": 64} for p in range(3)]
    store = side_store(list(zip(parts, metas, strict=True)), ["dims"], ["vec_id"])
    wanted = v.select("vec_id", F.explode(F.array(F.lit(900), F.lit(1000))).alias("tempo"))
    return wanted.join(store, "vec_id", "left")


@query(f"""WITH o AS (SELECT doc_id, source, coalesce(text, '') AS before, {_spoken("coalesce(text, '')")} AS after FROM documents), k AS (SELECT *, CASE WHEN after = '' THEN 'rejected' WHEN after <> before THEN 'changed' ELSE 'same' END AS state FROM o),
n AS (SELECT source, count(*) FILTER (WHERE state <> 'rejected') AS left_over FROM k GROUP BY 1) SELECT source, state, count(*) AS n, any_value(left_over) < 2 AS single FROM k JOIN n USING (source) GROUP BY ALL""")
def renormalize_report(spark, sf):
    """A catalogue under a new text version, in which all is spelt out: unchanged, changed and rejected rows by speaker, and speakers left with one."""
    o = table(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("before")).withColumn("after", R.spoken(F.col("before")))
    k = o.withColumn("state", F.when(F.col("after") == "", "rejected").when(F.col("after") != F.col("before"), "changed").otherwise("same"))
    counts = k.groupBy("source", "state").agg(F.count("*").alias("n"))
    left = counts.groupBy("source").agg((F.sum(F.when(F.col("state") != "rejected", F.col("n")).otherwise(0)) < 2).alias("single"))
    return counts.join(left, "source").select("source", "state", "n", "single")
