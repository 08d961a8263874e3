"""Sharding by balanced label propagation under the ``rows`` law.

Documents with equal texts are linked. Linked documents start dealt round over the shards; then each round every group's cells (group,
shard, rows) wish to move towards the shards where most of their neighbours are, from the smallest cells to the largest ones; what is wished from
shard to shard is summed up (shards x shards numbers), what goes both ways or round is exchanged, the rest moves as far as shards have
room, and these flows are the quotas that a join hands out to the cells. Every move goes to a cell no smaller, so a group's sum of squared
cells grows and cut edges become fewer, until no move is possible. Of equal cells one in a shard with room
counts as larger, else a hash decides, so that wishes face all ways. A group larger than a
shard stays cut, because counts may differ by one at most. Documents without links then fill every shard up to its count
exactly. ``slot`` numbers a shard's rows from 0.

Propagation works on cells, at most ``shards`` rows for a group however many copies it has, and all ranks
and quotas are prefix sums in two levels, so no task holds a group, a shard or the table.

Edge cases: null and empty texts have size 8 and equal each other; null doc_ids and repeated rows are rows
like others; fewer rows than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.hot import hot_join
from lexloom.operators.ranks import running
from lexloom.session import cut


def _wishes(cells: Column) -> Column:
    """Moves (shard, to, c) that a group would make: its cells, largest first, take what their shards can hold from its last cells upwards."""
    offers = F.transform(cells, lambda x, i: F.struct(x["shard"].alias("to"), x["more"].alias("n"), F.aggregate(F.slice(cells, 1, i), F.lit(0).cast("long"), lambda s, y: s + y["more"]).alias("at")))

    def source(x: Column, i: Column) -> Column:
        at = F.aggregate(F.slice(cells, i + 2, F.size(cells)), F.lit(0).cast("long"), lambda s, y: s + y["c"])
        share = lambda o: F.least(at + x["c"], o["at"] + o["n"]) - F.greatest(at, o["at"])
        return F.transform(F.slice(offers, 1, i), lambda o: F.struct(x["shard"].alias("shard"), o["to"].alias("to"), share(o).alias("c")))

    return F.filter(F.flatten(F.transform(cells, source)), lambda m: m["c"] > 0)


def flows(wanted: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may go from shard to shard: what is wished both ways or round three shards, then whatever there is room for."""
    left, out, shards = dict(wanted), {}, range(len(free))

    def take(n: int, *ways: tuple[int, int]) -> None:
        for way in ways:
            left[way] -= n
            out[way] = out.get(way, 0) + n

    for size in (2, 3):
        for round_ in permutations(shards, size):
            ways = [(round_[k], round_[(k + 1) % size]) for k in range(size)]
            if round_[0] == min(round_) and (n := min(left.get(w, 0) for w in ways)):
                take(n, *ways)
    for _ in range(len(free)):  # what leaves a shard makes room for others
        for i, j in sorted(left, key=lambda w: (-left[w], w)):
            if n := max(0, min(left[i, j], free[j])):
                take(n, (i, j))
                free[i], free[j] = free[i] + n, free[j] - n
    return out


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked for every row of ``docs`` (doc_id and text are read)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.concat(F.unhex(F.md5(text)), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))).alias("g"),
        )
    )
    n = rows.count()
    many = max(1, math.isqrt(n))
    h = F.xxhash64("doc_id", "g")
    bucket = F.pmod(h, F.lit(many))
    groups = cut(rows.groupBy("g").agg(F.count("*").alias("copies")).filter("copies > 1"))
    rows = cut(hot_join(rows.withColumn("h", h), groups, ["g"], "copies", "left").withColumn("linked", F.col("copies").isNotNull()).drop("copies"))
    linked, single = rows.filter("linked"), rows.filter("not linked")

    dealt = running(linked, [], bucket, ["h", "doc_id"], F.lit(1), "_r")
    cells = cut(dealt.groupBy("g", F.pmod("_r", F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("c")))
    room = spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(n // shards) + (F.col("id") < n % shards).cast("long")).alias("room"))
    space = [n // shards + (k < n % shards) for k in range(shards)]
    while True:  # ends, as every move goes to a cell no smaller and so makes a group's sum of squared cells larger
        load = cells.groupBy("shard").agg(F.sum("c").alias("load"))
        state = room.join(load, "shard", "left").withColumn("full", F.coalesce("load", F.lit(0)) >= F.col("room"))
        now = cells.join(F.broadcast(state), "shard").groupBy("g")  # one row for each shard
        cell = F.struct((-F.col("c")).alias("minus"), "full", F.xxhash64("g", "shard").alias("tie"), "shard", "c", (F.col("room") - F.col("c")).alias("more"))
        wishes = cut(now.agg(F.sort_array(F.collect_list(cell)).alias("cells")).filter(F.size("cells") > 1).select("g", F.inline(_wishes(F.col("cells")))))
        wanted = {(r["shard"], r["to"]): r["n"] for r in wishes.groupBy("shard", "to").agg(F.sum("c").alias("n")).collect()}  # shards x shards
        loads = {r["shard"]: r["load"] for r in load.collect()}  # one row for each shard
        quotas = flows(wanted, [space[k] - loads.get(k, 0) for k in range(shards)])
        if not quotas:
            break
        quota = spark.createDataFrame([(i, j, x) for (i, j), x in quotas.items()], "shard int, to int, quota long")
        asked = running(wishes.join(F.broadcast(quota), ["shard", "to"]), ["shard", "to"], F.pmod(F.xxhash64("g"), F.lit(many)), ["g"], F.col("c"), "_before")
        moves = cut(asked.withColumn("c", F.least("c", F.col("quota") - F.col("_before"))).filter("c > 0").select("g", "shard", "to", "c"))
        parts = cells.union(moves.select("g", "shard", -F.col("c"))).union(moves.select("g", "to", "c"))
        cells = cut(parts.groupBy("g", "shard").agg(F.sum("c").alias("c")).filter("c > 0"))

    upto = F.sum("c").over(Window.partitionBy("g").orderBy("shard"))
    plan = cells.withColumn("upto", upto).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("cells"))  # at most one entry a shard
    placed = cut(running(linked, ["g"], bucket, ["h", "doc_id"], F.lit(1), "_r"))
    placed = hot_join(placed, plan.join(groups, "g"), ["g"], "copies")
    placed = placed.withColumn("shard", F.filter("cells", lambda x: x["upto"] > F.col("_r"))[0]["shard"])

    load = {r["shard"]: r["load"] for r in cells.groupBy("shard").agg(F.sum("c").alias("load")).collect()}  # one row for each shard
    ends, total = [], 0
    for s in range(shards):
        total += n // shards + (s < n % shards) - load.get(s, 0)
        ends.append(total)
    rest = running(single, [], bucket, ["h", "doc_id"], F.lit(1), "_r")
    rest = rest.withColumn("shard", F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= F.col("_r"))))
    cols = ["doc_id", "size", "text_crc32", "h", "linked", "shard"]
    both = placed.select(*cols).union(rest.select(*cols))
    out = running(both, ["shard"], bucket_of("h", many), ["h", "doc_id"], F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


def bucket_of(column: str, many: int):
    return F.pmod(F.col(column), F.lit(many))
