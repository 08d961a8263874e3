"""Scans, projections and shards."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lexloom.operators.ranks import running
from lexloom.plans.registry import query, table


@query("SELECT doc_id, source, to_json({'lang': lang, 'n_chars': n_chars}) AS source_meta FROM documents")
def scan_project_residue(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", F.to_json(F.struct("lang", "n_chars")).alias("source_meta"))


@query("SELECT doc_id FROM documents WHERE doc_id % 8 = 3")
def partition_slice(spark, sf):
    """Shard 3 of 8 by row index (doc_id numbers the rows)."""
    return table(spark, sf, "documents").filter(F.pmod("doc_id", F.lit(8)) == 3).select("doc_id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT json_keys(props)) AS shapes FROM events GROUP BY 1")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.json_object_keys("props")).alias("shapes"))


@query("SELECT event_id, list_sort(json_keys(props)) AS names, props->>list_sort(json_keys(props))[1] AS first_value, to_json({'a': event_type, 'u': user_id}) AS dumped FROM events")
def json_documents(spark, sf):
    """JSON parsed into a map, its names in order, a value by name, and a record dumped with sorted names."""
    m = F.from_json("props", "map<string,string>")
    e = table(spark, sf, "events").select("event_id", F.sort_array(F.map_keys(m)).alias("names"), m.alias("m"), F.to_json(F.struct(F.col("event_type").alias("a"), F.col("user_id").alias("u"))).alias("dumped"))
    return e.select("event_id", "names", F.try_element_at("m", F.get("names", 0)).alias("first_value"), "dumped")


@query("SELECT source, to_json(map_from_entries(list_sort(list({'k': lang, 'v': n})))) AS counter FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def counters(spark, sf):
    """Counts of each source as one map."""
    n = table(spark, sf, "documents").filter("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n"))))).alias("counter"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def split_key_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"))


@query("SELECT i AS missing FROM (SELECT unnest(range(0, max(n_chars) // 100 + 1)) AS i FROM documents) WHERE i NOT IN (SELECT n_chars // 100 FROM documents WHERE n_chars IS NOT NULL)")
def missing_partitions(spark, sf):
    """Partitions of 100 characters, up to the longest document's, that no document of the table is in."""
    seen = table(spark, sf, "documents").select(F.expr("n_chars div 100").alias("missing")).distinct()
    return seen.agg(F.max("missing").alias("last")).select(F.explode(F.expr("sequence(0L, last)")).alias("missing")).join(seen, "missing", "left_anti")


@query("SELECT doc_id FROM documents WHERE n_chars > 2000 INTERSECT SELECT doc_id FROM labels")
def intersect_keys(spark, sf):
    return table(spark, sf, "documents").filter("n_chars > 2000").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 2 <> 0")
def union_partitions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return d.filter("doc_id % 2 = 0").unionByName(d.filter("doc_id % 2 <> 0"))


@query("SELECT doc_id, (r - 1) % 4 AS rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= n // 4 * 4")
def rank_stride(spark, sf):
    """Equal shares of each source for 4 ranks. Rows are numbered in ranges of doc_id and offset by the ranges before, so a source is in no one task."""
    d = table(spark, sf, "documents").select("source", "doc_id")
    ends = d.agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).first()
    width = max(1, -(-((ends["top"] or 0) + 1) // max(1, math.isqrt(ends["n"]))))
    rows = running(d, ["source"], F.floor(F.col("doc_id") / width), ["doc_id"], F.lit(1), "_r")
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(n) if n.count() <= 100_000 else n, "source").filter(F.expr("_r < n div 4 * 4")).select("doc_id", (F.col("_r") % 4).cast("long").alias("rank"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def key_set_gate(spark, sf):
    """Keys of one side that the other lacks."""
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")
