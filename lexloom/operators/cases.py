"""Greedy pairing without reuse, in rounds over all speakers: proposals from one sort, conflicts settled by least keys, until no pair is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.expr import hash01
from lexloom.operators.graph import fit
from lexloom.operators.order import places
from lexloom.session import cut

FINEST = -4  # cells are not narrower than 2**-4 seconds
PROBES = 32


def _overlap(a: str, b: str) -> Column:
    at = lambda side, c: F.col(f"{side}.{c}")
    return F.coalesce((at(a, "rec") == at(b, "rec")) & (at(a, "start") < at(b, "end")) & (at(b, "start") < at(a, "end")), F.lit(False))


def _apart(a: str = "a", b: str = "b") -> Column:
    return (F.col(f"{a}.session") != F.col(f"{b}.session")) & (F.col(f"{a}.digest") != F.col(f"{b}.digest")) & ~_overlap(a, b)


def _level(start: Column, end: Column) -> Column:
    return F.greatest(F.ceil(F.log2(end - start)), F.lit(FINEST)).cast("int")


def _cells(rows: DataFrame, level: str) -> DataFrame:
    """A row for each cell of 2**level seconds that the interval ``x`` touches: two at most, as no interval is longer than its level's cell."""
    width = F.pow(F.lit(2.0), F.col(level))
    both = F.array_distinct(F.array(F.floor(F.col("x.start") / width), F.floor(F.col("x.end") / width)))
    return rows.withColumn("cell", F.explode(both))


def _least(claims: DataFrame, checks: DataFrame, on: list[str]) -> DataFrame:
    """The keys that are the least one everywhere they look (minima are taken before rows meet)."""
    least = claims.groupBy(*on).agg(F.min("key").alias("least"))
    return checks.join(least, on).groupBy("key").agg(F.min(F.col("key") == F.col("least")).alias("won")).filter("won").select("key")


def _without_conflict(pairs: DataFrame, top: int | None) -> DataFrame:
    """Pairs (key, a, b) of which no two share content or, with ``top``, a stretch of a recording; the least of all keys is always among them.

    An interval claims the cells of its own size and of every larger size. It looks at all claims on its own cells, which holds whatever
    is as small or smaller and near, and at the claims of larger intervals on the cells around it: some rows for each interval, never a pair.
    """
    ends = pairs.select("key", F.explode(F.array("a", "b")).alias("x"))
    content = ends.select("key", F.col("x.digest").alias("digest"))
    won = _least(content, content, ["digest"])
    if top is not None:
        spans = ends.filter("x.rec is not null").withColumn("own", _level(F.col("x.start"), F.col("x.end")))
        at = _cells(spans.withColumn("level", F.explode(F.sequence("own", F.lit(top)))), "level").select("key", F.col("x.rec").alias("rec"), "own", "level", "cell")
        same = F.col("own") == F.col("level")
        claims = at.withColumn("large", F.lit(False)).union(at.filter(same).withColumn("large", F.lit(True)))
        checks = at.withColumn("large", ~same)
        # a large claim need not be there: cells nobody claimed at that size hold nothing to lose to
        lost = checks.join(claims.groupBy("rec", "level", "cell", "large").agg(F.min("key").alias("least")), ["rec", "level", "cell", "large"]).filter("least < key").select("key")
        won = won.join(lost, "key", "left_anti")
    return pairs.join(won, "key", "left_semi")


def _crossed(live: DataFrame, taken: DataFrame) -> DataFrame:
    """uid of rows whose interval overlaps one of ``taken``, which do not overlap each other: only the last that starts before a row's end can.

    One global order by recording and time; each range of it is read in order, and hands its last interval on to the next.
    """
    column = lambda pos, kind, other, uid: [F.col("x.rec").alias("rec"), F.col(pos).alias("pos"), F.lit(kind).alias("kind"), F.col(other).alias("other"), uid]
    marks = live.filter("rec is not null").select(F.struct("rec", "start", "end").alias("x"), "uid").select(*column("x.end", 0, "x.start", F.col("uid")))
    kind = dict(live.dtypes)["uid"]
    chosen = taken.filter("x.rec is not null").select(*column("x.start", 1, "x.end", F.lit(None).cast(kind).alias("uid")))
    order = ["rec", "pos", "kind"]
    rows = cut(marks.union(chosen).repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    last = F.when(F.col("kind") == 1, F.struct("rec", F.col("other").alias("end")))
    ends = rows.groupBy("part").agg(F.max_by(last, F.when(F.col("kind") == 1, F.struct(*order))).alias("tail"))  # one row a partition
    carried = F.last("tail", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = F.last(last, ignorenulls=True).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = rows.withColumn("before", before).join(F.broadcast(ends.select("part", carried.alias("carried"))), "part").withColumn("p", F.coalesce("before", "carried"))
    return met.filter("kind = 0 and p.rec = rec and p.end > other").select("uid")


def greedy_cases(rows: DataFrame, speaker: str, uid: str, digest: str, seed: int = 0, session: str | None = None, recording: str | None = None, limit: int | None = None) -> DataFrame:
    """speaker, uid, reference: pairs of one speaker in which no row, no content (``digest``) and no stretch of a recording is used twice.

    Content and recordings count across speakers. With ``session`` both rows need one and they must differ; ``recording`` comes with the
    columns start and end, and an interval that is none is an error (one with a missing part is no interval). No further pair could be
    added to the result. Rows without speaker, content or uid take no part, a uid that repeats counts once.

    A round sorts the rows by speaker and session, and the row at place i meets the one half a speaker further on: where the largest
    session has half the rows or fewer all meet another session, and where it has more, all others meet it. Of pairs in conflict the
    one with the least key stays. Rows that have no partner by the counts of their speaker's sessions and contents leave. In a round
    that ends empty a few rows of each speaker are held against all of it, and pair or leave. Nothing is sized by a speaker or a recording.
    """
    src = rows.select(F.col(speaker).alias("speaker"), F.col(uid).alias("uid"), F.col(digest).alias("digest"),
        F.col(session if session else digest).cast("string").alias("session"), *(F.col(c).alias(n) for c, n in ((recording, "rec"), ("start", "start"), ("end", "end")) if recording),
    )
    if recording:
        src = src.withColumn("start", F.col("start").cast("double")).withColumn("end", F.col("end").cast("double"))
        some = F.col("rec").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
        sound = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") < float("inf"))
        src = src.withColumn("rec", F.when(some & ~sound, F.raise_error(F.concat(F.lit("invalid source interval of "), F.col("uid").cast("string"))).cast(dict(src.dtypes)["rec"])).when(some, F.col("rec")))
    else:
        src = src.select("*", F.lit(None).cast("string").alias("rec"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"))
    src = src.filter("speaker is not null and uid is not null and digest is not null and session <> ''")
    rest = [c for c in src.columns if c != "uid"]
    live, left = fit(src.groupBy("uid").agg(F.min(F.struct(*rest)).alias("x")).select("uid", "x.*").select(*src.columns))
    top = None
    if recording:
        top = live.filter("rec is not null").agg(F.max(_level(F.col("start"), F.col("end")))).first()[0]
    row = F.struct("uid", "session", "digest", "rec", "start", "end")
    found, r = None, 0
    while left:
        h = F.xxhash64(F.lit(seed), F.lit(r), F.col("uid"))
        kinds = fit(live.groupBy("speaker", "session", "digest").agg(F.min_by(row, F.struct(h, "uid")).alias("x")))[0]
        n = {k: kinds.groupBy("speaker", *k).agg(F.count("*").alias(f"n{i}")) for i, k in enumerate(((), ("session",), ("digest",)))}
        for k, counts in n.items():
            kinds = kinds.join(counts, ["speaker", *k])
        alive = kinds.filter("n0 - n1 - n2 + 1 > 0").select("speaker", "session", "digest", "x", F.xxhash64(F.lit(seed), F.lit(r), "session").alias("sh"), F.xxhash64(F.lit(seed), F.lit(r), "x.uid").alias("h"))
        placed = places(alive, "speaker", "sh", "session", "h", F.col("x.uid"))
        firsts = placed.groupBy("speaker").agg(F.min("place").alias("first"), F.floor(F.count("*") / 2).alias("k"))
        i = F.col("place") - F.col("first")
        met = placed.join(firsts, "speaker").filter(i < 2 * F.col("k")).groupBy("speaker", F.pmod(i, F.col("k")).alias("slot")).agg(F.min_by("x", "place").alias("a"), F.max_by("x", "place").alias("b"))
        live, left = fit(live.join(placed.select("speaker", "session", "digest"), ["speaker", "session", "digest"], "left_semi"))
        if not left:
            break
        key = F.struct(F.xxhash64(F.lit(seed), F.lit(r), F.col("a.uid"), F.col("b.uid")).alias("h"), F.col("a.uid").alias("a"), F.col("b.uid").alias("b")).alias("key")
        pairs, n_pairs = fit(met.filter(_apart()).select("speaker", key, "a", "b"))
        lone = None
        if not n_pairs:
            w = Window.partitionBy("speaker").orderBy(h, "uid")
            some = live.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= PROBES).select("speaker", row.alias("a"))
            tried = some.join(live.select("speaker", row.alias("b")), "speaker").groupBy("speaker", "a").agg(F.min(F.when(_apart(), F.struct(F.xxhash64(F.lit(r), F.col("b.uid")).alias("h"), F.col("b").alias("b")))).alias("m"))
            tried = cut(tried.select("speaker", "a", F.col("m.b").alias("b")))
            lone = tried.filter("b is null").select(F.col("a.uid").alias("uid"))
            pairs = fit(tried.filter("b is not null").select("speaker", key, "a", "b"))[0]
        taken = cut(_without_conflict(pairs, top).select("speaker", "a", "b"))
        ends = taken.select(F.explode(F.array("a", "b")).alias("x"))
        live = live.join(ends.select("x.digest").distinct(), "digest", "left_anti")
        if lone is not None:
            live = live.join(lone, "uid", "left_anti")
        if top is not None:
            live = cut(live)
            live = live.join(_crossed(live, ends), "uid", "left_anti")
        live, left = fit(live.select(*src.columns))
        found, r = taken if found is None else found.union(taken), r + 1
    if found is None:
        found = live.select("speaker", row.alias("a"), row.alias("b"))
    # the target is the row that comes first in a seeded order
    place = lambda side: F.struct(hash01(F.lit(str(seed)), F.col(f"{side}.uid").cast("string")).alias("h"), F.col(f"{side}.uid").alias("uid"))
    out = found.select("speaker", F.least(place("a"), place("b")).alias("t"), F.greatest(place("a"), place("b")).alias("p"))
    if limit:
        out = out.orderBy("t").limit(limit)
    return out.select("speaker", F.col("t.uid").alias("uid"), F.col("p.uid").alias("reference"))
