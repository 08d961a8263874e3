"""The operators applied to their whole tables, with SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, clusters, language, lm, media, pieces, turns
from lexloom.llm.mixing import mix_sources
from lexloom.llm.near_dedup import near_duplicates
from lexloom.llm.quality import quality
from lexloom.llm.repeats import dedup_report
from lexloom.llm.sharding import shard
from lexloom.llm.urls import judge_urls

#: The vocabulary's file; a parameter of the operators, set by this variable for the queries.
PIECES = os.environ.get("LEXLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Fixed value: the pattern that the rank file belongs to.
BLANK_OR_RUN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks_path() -> str:
    """The rank file of the byte-level vocabulary; ``LEXLOOM_RANKS`` names another."""
    if at := os.environ.get("LEXLOOM_RANKS"):
        return at
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.remainder(3) == 1
    model = language.fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return language.predict(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2("text", 256)).withColumn("n_bytes", F.octet_length("text").cast("long"))
    back = pieces.round_trip(docs, PIECES, ("text_sha256", "n_bytes"))
    back = back.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decoded_sha256", F.sha2("text", 256))
    return back.select("doc_id", "n_bytes", "n_tokens", F.col("ids").alias("token_ids"), "decoded_sha256", F.col("text_sha256").eqNullSafe(F.col("decoded_sha256")).alias("round_trip"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe_media(media.encode_media(table(spark, sf_dir, "documents")))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.remainder(7) == 2
    model = lm.train(docs.filter(~held_out).select("text"))
    return lm.score(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).drop("linked")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = turns.reassemble(turns.deliveries(table(spark, sf_dir, "conversations"), 12), 12)
    what = F.when(F.col("event") == "close", F.array_join(F.col("waiting").cast("array<string>"), ",")).otherwise(F.col("body"))
    return events.select("event", "conv_id", "turn", "batch", F.sha2(what, 256).alias("sha256"), "n_missing", "n_breaks")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = clusters.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 64.0)
    return clusters.report(*clusters.cluster(points, 16, 3)).withColumnRenamed("id", "vec_id")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = bpe.Coder.load(ranks_path(), BLANK_OR_RUN)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return bpe.round_trip(docs, coder).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def _centroid_sql(rounds: int) -> str:
    """Rounds of assignment and replacement, one pair of steps after the other."""
    steps = ["""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM q QUALIFY c < 16)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT vec_id, q.v, c AS cluster, list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM q, c{i} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)""")
        if i < rounds:
            steps.append(f"""u{i} AS (SELECT cluster, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY 1, 2),
m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM u{i} GROUP BY 1), c{i + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m ON m.cluster = o.c)""")
    return ", ".join(steps) + f"""
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.cluster"""


_W = r"[^\x20\x09-\x0D]+"
ORACLES = {
    "op2_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
k AS (SELECT greatest(ceil(sqrt(count(*)) / 8), 1)::BIGINT AS k FROM d),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), coalesce((doc_id % k + k) % k, ('0x' || substr(digest, 1, 8))::UBIGINT::BIGINT % k), size, doc_id, digest) AS rank FROM d, k),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, source_size, ([5, 2, 1])[i % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level,
        row_number() OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, source) AS o
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level * weight <= cap THEN (SELECT g.level FROM f g WHERE g.level * g.weight <= g.cap ORDER BY g.o LIMIT 1) * weight ELSE cap::DOUBLE END AS target,
        ('0x' || substr(sha256('mix:' || coalesce(source, '')), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0 AS u FROM f),
c AS (SELECT doc_id, size, source_size, target, u, rank, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (floor(rate * rank + u) - floor(rate * (rank - 1) + u))::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e""",
    "op5_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS words, string_split(t, chr(10)) AS lines FROM d),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM dup, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(lines) AS line FROM w),
judged AS (SELECT doc_id, line, len(regexp_extract_all(line, '{_W}')) AS n,
  regexp_matches(line, '[.!?:;…。！？]["''»”’)\]]*[\x20\x09-\x0D]*$') AND NOT regexp_matches(line, '(?i)^\W*(home|menu|search|log ?in|log ?out|sign ?(in|up)|register|contact( us)?|about( us)?|next|previous|back( to top)?|read more|share|print|sitemap|skip to (main )?content)\W*$')
  AND NOT regexp_matches(line, '(?i)(all rights reserved|licensed under|released under the|copyright ©|\(c\) copyright|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|subscribe to our|enable javascript|lorem ipsum)')
  AND 10 * length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) <= 2 * len(regexp_extract_all(line, '{_W}'))
  AND 10 * (len(string_split(line, '!!')) - 1) <= 3 * len(regexp_extract_all(line, '{_W}')) AS ok FROM ln),
l AS (SELECT doc_id, (count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0))::BIGINT AS n_dup_lines, coalesce(sum(n) FILTER (WHERE ok AND n > 0), 0)::BIGINT AS good FROM judged GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  l.n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(words)::BIGINT - l.good AS lost_words
  FROM w JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 50 * n_words AS kept FROM b""",
    "op10_urls": r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(CASE WHEN contains(rest, '/') THEN substr(rest, 1, instr(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(rest, '/') THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM p),
r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, verdict DESC) AS i
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.i = 1""",
    "op11_turns": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, ('0x' || substr(sha256(coalesce(conv_id::VARCHAR, '') || ':' || turn), 1, 8))::UBIGINT::BIGINT AS h FROM conversations WHERE turn IS NOT NULL),
s AS (SELECT conv_id, turn, h % 12 AS batch, role, role || '|' || text AS payload FROM c UNION ALL SELECT conv_id, turn, (h + 3) % 12, 'user', 'user|' || text FROM c WHERE h % 7 < 2),
a AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, batch ORDER BY payload, role) AS i FROM s) WHERE i = 1),
b AS (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS next FROM (SELECT DISTINCT conv_id, batch FROM a)),
z AS (SELECT conv_id, min(CASE WHEN coalesce(next, 99) - batch > 3 AND batch + 3 <= 11 THEN batch + 3 ELSE 12 END) AS closed FROM b GROUP BY 1),
k AS (SELECT a.conv_id, turn, first, min(batch) AS batch, arg_min(role, batch) AS role, arg_min(payload, batch) AS payload FROM a JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id WHERE batch < closed GROUP BY ALL),
r AS (SELECT *, turn - first + 1 = row_number() OVER w AS released, max(batch) OVER w AS due, turn - 1 = lag(turn) OVER w AND role = lag(role) OVER w AS breaks FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE NOT released) AS waiting, max(turn) - min(first) + 1 - count(*) AS n_missing, count(*) FILTER (WHERE breaks) AS n_breaks FROM r GROUP BY 1)
SELECT 'release' AS event, conv_id, turn, due AS batch, sha256(payload) AS sha256, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM r WHERE released
UNION ALL SELECT 'reject', a.conv_id, turn, batch, sha256(payload), NULL, NULL FROM a JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id WHERE batch > closed
UNION ALL SELECT 'close', e.conv_id, -1, closed, sha256(coalesce(waiting, '')), n_missing, n_breaks FROM e JOIN z ON e.conv_id IS NOT DISTINCT FROM z.conv_id""",
    "op12_centroids": _centroid_sql(3),
}
