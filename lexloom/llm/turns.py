"""Turns of conversations that arrive late, twice or out of order, released in order by a stateful stream.

Arrivals come in numbered batches of files. For each batch the streaming query is started anew on one checkpoint; the batch's
number travels in the function's closure. The state of a conversation is a serialized min-heap of the kept turns
that wait, the next turn to release, the role of the last released one and a few counts; kept turns below the next one need no entry, as
the released run has no gaps. An arrival goes into the heap unless its turn is kept already, and while the heap's top is the next turn it is
popped and released. A conversation without arrivals is visited by its timeout, which compares the batch number with
that of its last arrival: after ``patience`` batches it is closed, and at the end (``last``) any open one is.
A closed conversation keeps a mark, by which later arrivals are rejected.

Every batch's folder holds one tick row besides its arrivals, so a batch without any runs too and visits the timeouts. State and sink are
Spark's own (a batch that is lost runs again from the checkpoint, and the file sink lists each batch once), so events come exactly once.
A conversation is one key of state, by the nature of the task; all else is spread by (conversation, turn).

Edge cases: rows without a turn are dropped; null roles and texts are empty; a null conv_id is one conversation of its own;
repeated rows of one batch arrive once, as the smallest payload, and of equal payloads the one with the smaller role; an empty table
gives no events.
"""

from __future__ import annotations

import heapq
import json
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.session import folder

EVENTS = "event string, conv_id long, turn long, batch long, role string, body string, waiting array<long>, n_missing long, n_breaks long"
STATE = "first long, next long, kept long, top long, role string, breaks long, seen long, closed boolean, heap string"
TICK = "tick"


def arrivals(rows: DataFrame) -> DataFrame:
    """conv, turn, role, body, batch, first: one row a turn and batch, the one with the smallest body. ``rows``: conv_id, turn, role, body, batch."""
    named = rows.filter("turn is not null").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("body", F.lit("")).alias("body"), "batch")
    one = named.groupBy("conv", "turn", "batch").agg(F.min(F.struct("body", "role")).alias("m")).select("conv", "turn", "m.role", "m.body", "batch")
    return one.join(named.groupBy("conv").agg(F.min("turn").alias("first")), "conv")


def _event(kind: str, conv: str, turn: int, batch: int, role=None, body=None, waiting=None, missing=None, breaks=None) -> tuple:
    return kind, int(conv) if conv else None, turn, batch, role, body, waiting, missing, breaks


def handler(batch: int, patience: int, last: bool):
    """The state function of one batch."""

    def visit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        conv, events = key[0], []
        if conv == TICK:
            for _ in frames:
                pass
            return
        if state.exists:
            first, nxt, kept, top, role, breaks, seen, closed, text = state.get
            heap = json.loads(text)
        else:
            first = nxt = top = seen = None
            kept, role, breaks, closed, heap = 0, None, 0, False, []
        roles = {t: r for t, r, _ in heap}  # of the kept turns that wait
        if not state.hasTimedOut:
            came = [row for f in frames for row in zip(f["turn"].tolist(), f["role"].tolist(), f["body"].tolist(), f["first"].tolist(), strict=True)]
            if came and not closed:
                seen = batch
            for turn, r, body, start in came:
                if closed:
                    events.append(_event("reject", conv, turn, batch, r, body))
                    continue
                if first is None:
                    first = nxt = start
                    top = start - 1
                if turn < nxt or turn in roles:
                    continue  # kept before
                before = role if turn == nxt and turn > first else roles.get(turn - 1)
                breaks += (before is not None and before == r) + (roles.get(turn + 1) == r)
                roles[turn] = r
                heapq.heappush(heap, [turn, r, body])
                kept, top = kept + 1, max(top, turn)
            while heap and heap[0][0] == nxt:
                turn, role, body = heapq.heappop(heap)
                events.append(_event("release", conv, turn, batch, role, body))
                nxt += 1
        if not closed and (last or batch - seen >= patience):
            closed = True
            events.append(_event("close", conv, -1, batch, waiting=sorted(t for t, _, _ in heap), missing=top - first + 1 - kept, breaks=breaks))
            heap = []
        state.update((first, nxt, kept, top, role, breaks, seen, closed, json.dumps(heap)))
        if not closed:
            state.setTimeoutDuration(1)  # due in the next batch, whenever that is
        if events:
            yield pd.DataFrame(events, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"conv_id": "Int64", "n_missing": "Int64", "n_breaks": "Int64"})

    return visit


def reassemble(rows: DataFrame, batches: int, patience: int = 3) -> DataFrame:
    """Events of ``rows`` (conv_id, turn, role, body, batch in 0 .. batches - 1): release and reject with role and body, and close with the
    turns that still wait, how many are missing below the greatest kept one, and how many repeat the role before them."""
    spark = rows.sparkSession
    at = f"{folder(spark)}/turns-{uuid.uuid4().hex}"
    came = arrivals(rows)
    ticks = spark.range(batches + 1, numPartitions=1).select(F.lit(TICK).alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("body"), F.col("id").cast("int").alias("batch"), F.lit(None).cast("long").alias("first"))
    came.unionByName(ticks).hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{at}/staged")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{at}/feed"))
    schema = "conv string, turn long, role string, body string, first long, batch int"
    off = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(off)
    spark.conf.set(off, "false")
    try:
        for batch in range(batches + 1):
            fs.rename(path(f"{at}/staged/batch={batch}"), path(f"{at}/feed/batch={batch}"))
            fed = spark.readStream.schema(schema).option("basePath", f"{at}/feed").parquet(f"{at}/feed")
            out = fed.groupBy("conv").applyInPandasWithState(handler(batch, patience, batch == batches), EVENTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
            run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/marks").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
            time.sleep(0.002)  # timeouts of one millisecond are over
    finally:
        spark.conf.set(off, before)
    return spark.read.schema(EVENTS).parquet(f"{at}/out")


def deliveries(conversations: DataFrame, batches: int = 12) -> DataFrame:
    """Rows of conversations dealt to batches by a hash of conversation and turn; some come a second time, three batches on, as the user's."""
    named = conversations.filter("turn is not null").withColumn("id", F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string")))
    h = F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long")
    text = F.coalesce("text", F.lit(""))
    once = F.struct((F.col("h") % batches).cast("int").alias("batch"), F.coalesce("role", F.lit("")).alias("role"))
    again = F.struct(((F.col("h") + 3) % batches).cast("int").alias("batch"), F.lit("user").alias("role"))
    sent = named.select("conv_id", F.col("turn").cast("long").alias("turn"), text.alias("text"), h.alias("h"), "role").select("conv_id", "turn", "text", F.explode(F.when(F.col("h") % 7 < 2, F.array(once, again)).otherwise(F.array(once))).alias("sent"))
    return sent.select("conv_id", "turn", "sent.role", F.concat("sent.role", F.lit("|"), "text").alias("body"), "sent.batch")
