"""Near duplicates by MinHash: one-permutation hashing with optimal densification, banded buckets, star edges.

Contract. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A document's set holds its distinct
five-word shingles; with fewer words the whole sequence is the one member; without words the set is
empty and linked with nothing. Two documents are linked when ``100 * |A & B| >= 85 * |A | B|``, which is
confirmed on the full sets.

How. Equal sets collapse to one representative (the smallest doc_id) before anything is compared, so
copies cost one row each. A representative's 240 bins (40 bands of 6) put it into 40 buckets. In each
round every bucket that still spans several components sends star edges from hubs to its members of
other components: one hub in the first round, then 32, 1024, ..., least loose first. Two exact
bounds drop pairs that cannot reach the threshold before they are made: the distance of two bit sketches, and the
shingles that only one remaining candidate has, which lie in no intersection; so loose variants of a hot text are
settled without being compared. The rest is confirmed on full sets, confirmed links merge components, and a hub leaves its
bucket, all of its pairs being settled. It ends when no bucket spans two components: every
candidate pair was then confirmed, refused, or already connected. No partner is capped.

At similarity 0.85 one pair shares no band with probability (1 - 0.85**6)**40 < 1e-8, at 0.8 with about 5e-6.

Edge cases. Null or wordless text: empty set, own component, kept. A null doc_id takes part in
nothing: its component_id is null and it is kept. Rows that repeat a doc_id are one document for linking.
Further input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import kernel as K
from lexloom.llm.sieve import sieve
from lexloom.operators.graph import components, fit
from lexloom.session import cut, prepare, release

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
SKETCH = 16
_PROBES = np.random.default_rng(77).integers(0, BINS, (8192, BINS))


def densify(sig: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Optimal densification: an empty bin copies the first filled bin of its own fixed probe sequence."""
    rows, cols = np.nonzero(~filled & filled.any(1)[:, None])
    for probe in _PROBES:
        if not len(rows):
            break
        at = probe[cols]
        hit = filled[rows, at]
        sig[rows[hit], cols[hit]] = sig[rows[hit], at[hit]]
        rows, cols = rows[~hit], cols[~hit]
    if len(rows):
        sig[rows, cols] = sig[rows, filled[rows].argmax(1)]
    return sig


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation MinHash: the upper half of a hash chooses its bin, whose least hash stands for it."""
    sig = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, u in enumerate(sets):
        bins = (((u >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        sig[i, bins[first]] = u[first]
        filled[i, bins[first]] = True
    return densify(sig, filled)


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * K.COEF[ROWS], parts.shape[:2]).copy()
    for k in range(ROWS):
        key += parts[:, :, k] * K.COEF[k]
    return K.mix(key).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = K.column_bytes(batch.column(1))
        for i, j in K.chunks(off, 1 << 18):
            sets = list(K.shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            keys = band_keys(signature(sets))
            has = np.array([len(s) > 0 for s in sets])
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32), pa.array(keys[has].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), lists],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )


def sketch(members: np.ndarray) -> np.ndarray:
    """A set's members as bits of SKETCH longs: bits that differ between two sets come from members that only one of them has."""
    out = np.zeros(SKETCH * 8, np.uint8)
    np.bitwise_or.at(out, ((members >> np.uint64(3)) & np.uint64(SKETCH * 8 - 1)).astype(np.int64), np.uint8(1) << (members & np.uint64(7)).astype(np.uint8))
    return out.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = K.column_bytes(batch.column(1))
        for i, j in K.chunks(off, 1 << 18):
            sets = list(K.shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            bits = pa.ListArray.from_arrays(np.arange(0, len(sets) * SKETCH + 1, SKETCH, dtype=np.int32), pa.array(np.concatenate([sketch(s) for s in sets])))
            digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            members = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), digests, members, bits], ["rep", "set_key", "members", "sketch"])


def _members(texts: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, members (the full set), sketch of the representatives ``ids``: read again from the texts, as only candidates need them."""
    sets = sieve(texts, "doc_id", ids).mapInArrow(_sets, "rep long, set_key binary, members array<long>, sketch array<long>")
    return sets.join(ids, "rep", "left_semi").join(reps, ["rep", "set_key"], "left_semi").dropDuplicates(["rep"])


def _unshared(texts: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, alone: how many of its shingles no other one of ``ids`` has. They lie in no intersection, which bounds every similarity."""
    rows = _members(texts, reps, ids).select("rep", F.explode("members").alias("shingle"))
    once = rows.groupBy("shingle").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).filter("c = 1")
    return fit(once.groupBy("rep").agg(F.count("*").alias("alone")))[0]


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """node, comp after new links: only the components that these join are worked on."""
    ends = links.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    ends = cut(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    of = components(ends.select("ca", "cb")).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    nodes = comps.union(ends.select("a", "ca")).union(ends.select("b", "cb")).distinct()
    return fit(nodes.join(of, nodes.comp == of.old, "left").select("node", F.coalesce("new", "comp").alias("comp")))[0]


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (columns doc_id and text are read)."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = cut(texts.mapInArrow(_signatures, "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    reps = cut(sig.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))

    spread = sig.alias("s").join(reps.alias("r"), (F.col("s.doc_id") == F.col("r.rep")) & (F.col("s.set_key") == F.col("r.set_key"))).select(F.col("r.rep").alias("rep"), F.col("r.n").alias("n"), F.explode("s.bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("band")
    members, _ = fit(spread.join(shared, "band").select("band", "rep", "n").distinct())

    comps = spark.createDataFrame([], "node long, comp long")
    alone = spark.createDataFrame([], "rep long, alone long")
    sketches, _ = fit(_members(texts, reps, members.select("rep").distinct()).select("rep", "sketch"))
    tested = spark.createDataFrame([], "a long, b long")
    rounds = 0
    while True:
        hubs = 32**rounds
        if rounds == 1:
            alone = _unshared(texts, reps, members.select("rep").distinct())
        priority = -(1000 * F.col("alone") / F.col("n")).cast("long")
        now = (
            members.join(comps, members.rep == comps.node, "left").join(sketches, "rep").join(alone, "rep", "left")
            .withColumn("alone", F.coalesce("alone", F.lit(0))).withColumn("comp", F.coalesce("comp", "rep")).filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
            .select("band", "rep", "n", "comp", "alone", "sketch", F.struct(priority.alias("priority"), F.xxhash64("rep").alias("h"), "rep", "n", "alone").alias("rank"), F.pmod(F.xxhash64("rep", F.lit(rounds)), F.lit(hubs)).alias("slot"))
        )
        hub = now.groupBy("band", "slot").agg(F.max(F.struct("rank", "comp", "sketch")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        mixed = hub.groupBy("band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("band")
        hub, n_hubs = fit(hub.join(mixed, "band", "left_semi").select("band", F.col("hub.rank.rep").alias("hub"), F.col("hub.rank.n").alias("hub_n"), F.col("hub.rank.alone").alias("hub_alone"), F.col("hub.comp").alias("hub_comp"), F.col("hub.sketch").alias("hub_sketch")))
        if not n_hubs:
            break
        most = F.least(F.col("n") - F.col("alone"), F.col("hub_n") - F.col("hub_alone"))
        may = (F.col("comp") != F.col("hub_comp")) & (100 * most >= percent * (F.col("n") + F.col("hub_n") - most))
        # |A ^ B| is at least the sketches' distance, and at most (100 - p) / (100 + p) of |A| + |B| for a link
        left = now.select("band", "rep", "n", "comp", "alone", *(F.col("sketch")[i].alias(f"_s{i}") for i in range(SKETCH)))
        right = hub.select(*(c for c in hub.columns if c != "hub_sketch"), *(F.col("hub_sketch")[i].alias(f"_h{i}") for i in range(SKETCH)))
        distance = sum((F.bit_count(F.col(f"_s{i}").bitwiseXOR(F.col(f"_h{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("_s0").bitwiseXOR(F.col("_h0"))))
        may = may & ((100 + percent) * distance <= (100 - percent) * (F.col("n") + F.col("hub_n")))
        pairs = left.join(right, "band").filter(may).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
        pairs, n_pairs = fit(pairs.join(tested, ["a", "b"], "left_anti"))
        if n_pairs:
            ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
            sets = cut(_members(texts, reps, ids).select("rep", "members"))
            left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("x")), "a")
            both = left.join(sets.select(F.col("rep").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
            shared = F.size(F.array_intersect("x", "y"))  # members are distinct
            found, n_found = fit(both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"))
            if n_found:
                comps = _merged(comps, found)
            tested = tested.union(pairs)
        open_bands = hub.select("band").distinct()
        members, _ = fit(now.select("band", "rep", "n").join(open_bands, "band", "left_semi").join(hub.select("band", F.col("hub").alias("rep")), ["band", "rep"], "left_anti"))
        rounds += 1
        release(spark)

    named = reps.join(comps, reps.rep == comps.node, "left").select("set_key", F.coalesce("comp", "rep").alias("comp"))
    out = sig.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
