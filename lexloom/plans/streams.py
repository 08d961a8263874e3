"""File-arrival streams: one micro-batch a trigger, checkpoints as done marks, idempotent sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.plans.registry import query
from lexloom.session import prepare
from lexloom.streaming.shards import available_now, poll, run_available
from lexloom.streaming.windows import sessions, sliding, tumbling


@query("SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def stream_available_now(spark, sf):
    """All files that have arrived go through the stream once; the sink is read back."""
    prepare(spark)
    base = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf) if sf.startswith("/") else spark.readStream.schema(schema).parquet(f"{sf}/events.parquet")
    available_now(source, lambda df: df.select("event_type", "value"), f"{base}/out", f"{base}/marks")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _folder(spark):
    prepare(spark)
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf) if sf.startswith("/") else spark.readStream.schema(schema).parquet(f"{sf}/events.parquet")


def _settled(spark, stream):
    """A stream's final windows, read back from its sink."""
    at = _folder(spark)
    query_ = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/marks").outputMode("append").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


CLOSED = "m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events)"


@query("SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1 UNION ALL SELECT 'all users', count(DISTINCT user_id), max(value) FROM events")
def stream_two_consumers(spark, sf):
    """Two consumers of one pass over what has arrived; both sinks read back."""
    at = _folder(spark)
    by_type = lambda df: df.select("event_type", "value")
    by_user = lambda df: df.groupBy("user_id").agg(F.max("value").alias("value"))
    run_available(_events(spark, sf), {"types": by_type, "users": by_user}, f"{at}/out", f"{at}/marks")
    types = spark.read.parquet(f"{at}/out/types").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    users = spark.read.parquet(f"{at}/out/users").agg(F.lit("all users").alias("event_type"), F.count_distinct("user_id").alias("n"), F.max("value").alias("top"))
    return types.unionByName(users)


@query(f"""WITH {CLOSED}, w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS s, event_type, value FROM events) SELECT s AS start, event_type, count(*) AS n, max(value) AS top FROM w, m WHERE s + INTERVAL 6 HOURS <= m.w GROUP BY ALL""")
def tumbling_windows(spark, sf):
    """Windows of six hours that the watermark has closed (an extension)."""
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _settled(spark, tumbling(e, "ts", "1 hour", "6 hours", ["event_type"], F.count("*").alias("n"), F.max("value").alias("top")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "top")


@query(f"""WITH {CLOSED}, w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS s, value FROM events, (VALUES (0), (1)) v(k)) SELECT s AS start, count(*) AS n FROM w, m WHERE s + INTERVAL 12 HOURS <= m.w GROUP BY 1""")
def sliding_windows(spark, sf):
    """Windows of twelve hours, every six (an extension)."""
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _settled(spark, sliding(e, "ts", "1 hour", "12 hours", "6 hours", [], F.count("*").alias("n")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"""WITH {CLOSED}, g AS (SELECT user_id, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS fin, count(*) AS n FROM i GROUP BY user_id, k) SELECT user_id, start, n FROM s, m WHERE fin <= m.w""")
def session_windows(spark, sf):
    """A user's events with less than two hours between them (an extension)."""
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _settled(spark, sessions(e, "ts", "1 hour", "2 hours", ["user_id"], F.count("*").alias("n")))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT source, count(DISTINCT lang) AS scored FROM documents GROUP BY 1")
def polled_work(spark, sf):
    """Work polled twice: the second time nothing is left to score, and the store has each key once."""
    at = _folder(spark)
    found = spark.read.parquet(f"{sf}/documents.parquet").select("source", "lang")
    score = lambda df: df.withColumn("score", F.length("source"))
    poll(found.filter("lang = 'en'"), score, at, ["source", "lang"])
    poll(found, score, at, ["source", "lang"])
    poll(found, score, at, ["source", "lang"])
    return spark.read.parquet(f"{at}/done").groupBy("source").agg(F.count("lang").alias("scored"))
