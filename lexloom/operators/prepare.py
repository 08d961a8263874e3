"""Preparing and merging partitions, and building manifests: rule chains with messages, first-wins dedup, gates, sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators import graph
from lexloom.operators.curate import first_reason
from lexloom.operators.order import places
from lexloom.operators.quantiles import exact_quantiles
from lexloom.session import Tables, cut


def messages(*rules: tuple[Column, Column | str]) -> Column:
    """The message of the first rule whose condition is true, or NULL."""
    return F.coalesce(*(F.when(broken, F.lit(text) if isinstance(text, str) else text) for broken, text in rules))


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """``df``; an error where it has no row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


#: Parallel rounds before what is left is looked at in components, and rows of the largest component that one task takes in a pass.
ROUNDS, PASS_ROWS = 2, 1 << 20


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Accepted rows of components that come one after the other, each in order: what is seen is forgotten with its component."""
    at, xs, ys = None, set(), set()
    for frame in frames:
        kept = []
        for comp, o, x, y in zip(frame["comp"], frame["o"], frame["x"], frame["y"], strict=True):
            if comp != at:
                at, xs, ys = comp, set(), set()
            if x in xs or y in ys:
                continue
            kept.append(o)
            if x is not None:
                xs.add(x)
            if y is not None:
                ys.add(y)
        yield pd.DataFrame({"o": np.array(kept, np.int64)})


def first_of_two(df: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """``df`` with ``duplicate``: whether an accepted earlier row has the same ``a`` or the same ``b``. ``order`` is unique; a null key is like no other.

    A row is accepted at once if it comes first among the open rows of both its keys, and what shares a key with it goes: a few such
    rounds in parallel settle keys that many rows share. Rows that are still open hang together by keys only in small components
    (connected components over edges from each row to the first row of its key), and each is gone through in order, many to a
    task, so the number of rounds does not grow with chains. A component beyond ``PASS_ROWS`` gets further rounds first.
    """
    rows = df.select(F.col(order).alias("at"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
    whole = dict(df.dtypes)[order] in ("bigint", "int", "smallint", "tinyint")
    left = cut(rows.withColumn("o", F.col("at").cast("long"))) if whole else cut(places(rows, "at", name="o"))
    accepted, done = [], 0
    while True:
        first_x = left.filter("x is not null").groupBy("x").agg(F.min("o").alias("fx"))
        first_y = left.filter("y is not null").groupBy("y").agg(F.min("o").alias("fy"))
        met = left.join(first_x, "x", "left").join(first_y, "y", "left")
        if done >= ROUNDS:
            met = cut(met)
            edges = met.select(F.col("o").alias("u"), F.col("fx").alias("v")).union(met.select("o", "fy")).filter("u != v")
            named = met.join(graph.components(edges), F.col("o") == F.col("node"), "left").select(F.coalesce("comp", "o").alias("comp"), "at", "o", "x", "y")
            named = cut(named)
            largest = named.groupBy("comp").count().agg(F.max("count")).first()[0] or 0
            if largest <= PASS_ROWS:
                kept = named.repartition("comp").sortWithinPartitions("comp", "o").select("comp", "o", "x", "y").mapInPandas(_in_order, "o long")
                accepted.append(cut(named.join(kept, "o", "left_semi").select("at")))
                break
        new = cut(met.filter("(x is null or o = fx) and (y is null or o = fy)").select("at", "o", "x", "y"))
        accepted.append(new.select("at"))
        rest = left.join(new.select("o"), "o", "left_anti").join(new.select("x"), "x", "left_anti").join(new.select("y"), "y", "left_anti")
        left, done = cut(rest.select("at", "o", "x", "y")), done + 1
        if left.isEmpty():
            break
    kept = accepted[0]
    for part in accepted[1:]:
        kept = kept.union(part)
    return df.join(kept.select(F.col("at").alias(order), F.lit(False).alias("_first")), order, "left").withColumn("duplicate", F.col("_first").isNull()).drop("_first")


def measured_rules(error: Column, seconds: Column, level: Column, bandwidth: Column, speech: Column, shortest: float, longest: float, silent: float = 1e-5, least_bandwidth: float = 0.0, least_speech: float = 0.0) -> list[tuple[str, Column]]:
    """The rules that need a sound's measures, cheapest first; a measure that is missing breaks no rule, but a length that is missing does."""
    return [
        ("decode_error", error.isNotNull()),
        ("duration", ~F.coalesce(seconds.between(shortest, longest), F.lit(False))),
        ("silent", level < silent),
        ("bandwidth", bandwidth < least_bandwidth),
        ("speech_ratio", speech < least_speech),
    ]


def channel_sums(df: DataFrame, vector: str) -> DataFrame:
    """channel, n, s, q: sums that partitions can add up."""
    x = df.select(F.posexplode(vector).alias("channel", "v")).withColumn("v", F.col("v").cast("double"))
    return x.groupBy("channel").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, at: str) -> bool:
    path, fs = _path(spark, at)
    return fs.exists(path)


def write_json(spark: SparkSession, at: str, value: dict) -> None:
    path, fs = _path(spark, at)
    out = fs.create(path, False)
    out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
    out.close()


def read_json(spark: SparkSession, at: str) -> dict:
    return json.loads(spark.read.text(at, wholetext=True).first()[0])


def prepare_partition(rows: DataFrame, out: str, error: Column, settings: dict, vector: str | None = None) -> dict:
    """Write one partition: samples, rejected rows with their messages, channel sums of train rows, and metadata as the mark of completion.

    ``rows`` has uid, digest, split and an order column ``arrival``; rows without an error are deduplicated by uid and by digest in
    that order. An output that exists and a partition without accepted rows are errors.
    """
    spark = rows.sparkSession
    if exists(spark, f"{out}/metadata.json"):
        raise ValueError("output already contains a partition")
    judged = cut(rows.withColumn("error", error))
    good = first_of_two(judged.filter("error is null"), "uid", "digest", "arrival")
    tables = Tables(spark)
    good = tables.write("good", good)
    kept = good.filter("not duplicate").drop("duplicate", "error")
    lost = judged.filter("error is not null").select("uid", "error").union(good.filter("duplicate").select("uid", F.lit("Duplicate audio or ID").alias("error")))
    not_empty(kept, "the partition: no accepted samples; its rejected rows are in the log")
    kept.write.parquet(f"{out}/samples")
    lost.write.json(f"{out}/rejected")
    if vector:
        channel_sums(kept.filter("split = 'train'"), vector).write.parquet(f"{out}/stats")
    counts = {"accepted": kept.count(), "rejected": lost.count()}
    meta = settings | counts | {"complete": True}
    write_json(spark, f"{out}/metadata.json", meta)  # the completion mark comes last
    tables.drop()
    return meta


def check_partitions(metas: Sequence[dict], same: Sequence[str]) -> None:
    """Errors for partitions that are incomplete, missing, or made with other settings."""
    for m in metas:
        if not m.get("complete"):
            raise ValueError("incomplete partition")
        for key in same:
            if m.get(key) != metas[0].get(key):
                raise ValueError(f"incompatible partitions: {key}")
    found: dict[tuple, set] = {}
    for m in metas:
        if "partition" in m:
            found.setdefault((m.get("source"), m["partitions"]), set()).add(m["partition"])
    for (source, n), seen in found.items():
        if seen != set(range(n)):
            raise ValueError(f"missing partitions for {source}: expected {n}, found {sorted(seen)}")


def merged(samples: DataFrame, drop_conflicts: bool = False, drop_uids: DataFrame | None = None, keep_singletons: bool = False, speaker: str = "speaker", split_map: DataFrame | None = None, vector: str | None = None) -> tuple[DataFrame, dict]:
    """Samples of all partitions as one catalogue, and what went: copies by digest (first wins), conflicting copies, dropped ids, single speakers.

    ``samples`` has uid, digest, speaker, text, split and a unique ``arrival``. One uid with two digests, a copy with other labels (unless
    ``drop_conflicts``) and a speaker in two splits are errors. ``split_map`` (the speaker's column and ``mapped``) gives speakers another split first;
    with ``vector`` the report has count, mean and deviation of each channel over the train rows that are left, from sums that add up.
    """
    samples = cut(samples)
    clash = samples.groupBy("uid").agg(F.count_distinct("digest").alias("n")).filter("n > 1").select("uid").first()
    if clash:
        raise ValueError(f"id collision with different content: {clash[0]}")
    label = F.struct(speaker, "text", "split")
    firsts = samples.groupBy("digest").agg(F.min(F.struct("arrival", label.alias("label"))).alias("f"))
    named = samples.join(firsts, "digest").select(samples["*"], (F.col("arrival") == F.col("f.arrival")).alias("_first"), label.eqNullSafe(F.col("f.label")).alias("_same"))
    named = cut(named)
    conflicts = named.filter("not _same").count()
    if conflicts and not drop_conflicts:
        raise ValueError(f"duplicate content has inconsistent labels: {named.filter('not _same').first()['uid']}")
    kept = named.filter("_first").drop("_first", "_same")
    moved = 0
    if split_map is not None:
        kept = cut(kept.join(split_map.select(speaker, "mapped"), speaker, "left"))
        moved = kept.filter("mapped != split").count()
        kept = kept.withColumn("split", F.coalesce("mapped", "split")).drop("mapped")
    divided = kept.groupBy(speaker).agg(F.count_distinct("split").alias("n")).filter("n > 1").first()
    if divided:
        raise ValueError(f"speaker appears across splits: {divided[0]}")
    before = kept.count()
    if drop_uids is not None:
        kept = kept.join(drop_uids, "uid", "left_anti")
    after_drop = kept.count()
    if not keep_singletons:
        many = kept.groupBy(speaker).agg(F.count("*").alias("n")).filter("n > 1").select(speaker)
        kept = kept.join(many, speaker, "left_semi")
    kept = cut(kept)
    n = kept.count()
    report = {"duplicates": named.count() - before - conflicts, "conflicts": conflicts, "dropped": before - after_drop, "singletons": after_drop - n, "samples": n, "reassigned": moved}
    if vector:
        sums = channel_sums(kept.filter("split = 'train'"), vector).orderBy("channel").collect()  # a row a channel
        report["channels"] = [(r["n"], r["s"] / r["n"], max(max(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2, 0.0) ** 0.5, 1e-6)) for r in sums]
    return kept, report


def cleaned(side: DataFrame, kept: DataFrame, uid: str) -> tuple[DataFrame, int]:
    """Rows of a side table whose sample is still there, and how many went."""
    rows = cut(side.join(kept.select(uid), uid, "left_semi"))
    return rows, side.count() - rows.count()


def side_store(parts: Sequence[tuple[DataFrame, dict]], same: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Parts of a side store (table, metadata) as one table. Incomplete or missing parts, parts made with other settings, and a key that two parts have are errors."""
    check_partitions([meta for _, meta in parts], same)
    store = parts[0][0]
    for part, _ in parts[1:]:
        store = store.unionByName(part)
    store = cut(store)
    twice = store.groupBy(*keys).count().filter("count > 1").first()
    if twice:
        raise ValueError(f"two parts have {tuple(twice)[: len(keys)]}")
    return store


def build_manifest(candidates: DataFrame, metadata: Sequence[tuple[str, Column]], measured: Sequence[tuple[str, Column]], rate: str, keep: Column | None = None, cap: tuple[str, int] | None = None, k: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and every selected row with its reason.

    Cheapest first: sample (``keep``), metadata rules, measured rules, then a fence over all that passed by ``rate`` (one row of
    quartiles, broadcast), then a cap by group in order of ``id`` that counts survivors only.
    """
    rows = candidates if keep is None else candidates.filter(keep)
    rows = rows.withColumn("reason", first_reason(*metadata, *measured))
    rows = cut(rows)
    q = exact_quantiles(rows.filter("reason is null"), (), rate, (0.25, 0.75)).select(F.col("q").alias("_q"))
    wide = (F.col("_q")[1] - F.col("_q")[0]) * k
    out = (F.col(rate) < F.col("_q")[0] - wide) | (F.col(rate) > F.col("_q")[1] + wide)
    rows = rows.join(F.broadcast(q), how="left").withColumn("reason", F.coalesce("reason", F.when(out, "rate_outlier"))).drop("_q")
    if cap:
        group, most = cap
        best = rows.filter("reason is null").select("id", F.row_number().over(Window.partitionBy(group).orderBy("id")).alias("_k")).filter(F.col("_k") > most).select("id", F.lit("group_cap").alias("_cap"))
        rows = rows.join(best, "id", "left").withColumn("reason", F.coalesce("reason", "_cap")).drop("_cap")
    rows = cut(rows)
    return rows.filter("reason is null").drop("reason"), rows


def inventory_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted paths, sizes and times of a tree's files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "^file:", "").alias("p"), "length", F.unix_micros("modificationTime").alias("t"))
    root = path.rstrip("/")
    digest = hashlib.sha256()
    for r in files.orderBy("p").toLocalIterator():  # a line a file, streamed
        digest.update(f"{r['p'].removeprefix(root)}\t{r['length']}\t{r['t']}\n".encode())
    return digest.hexdigest()
