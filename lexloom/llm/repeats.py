"""Removal of repeated byte strings: every byte covered by a ``WINDOW``-byte string that also starts earlier goes.

Texts are UTF-8 bytes (null: empty), matches never cross documents, "earlier" means a smaller doc_id or, in
one document, an earlier start; strings are judged on the input. Every string counts, at any byte offset.

How. It is the difference-cover scheme with a content-chosen sample in place of positions modulo three
(``anchors.py``; README, "Suffix arrays", has why and the figures): sampled strings are counted and named; occurrences get a second name
from everything around them that their windows see; all but the first occurrence of such a context are
repeats as a whole; where one sampled string has several contexts, the windows next to it are merged by
their cores and at last compared one by one. Each pass reads the texts again and moves only what the pass before left open, told by
bit sets: a set bit that nobody meant costs rows, never a result. A set has a bit for sixteen bytes of text, at least 2**20 and at
most 2**31 (256 MB, the bound of what is broadcast); above 34 GB of text the sets fill up and save less.
Strings count as equal when two independent polynomial hashes agree, 96 bits together.
No occurrence is capped; keys that hold more than an eighth of a task's share meet their first occurrence by a broadcast (at most
eight such keys a task), so no task holds a group.

Edge cases: texts under ``WINDOW`` bytes lose nothing; a null doc_id loses nothing and hides nothing; rows that
repeat a doc_id are documents of their own, in the order of their texts' hashes, and equal rows are one document, each of
them losing the same; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import kernel as K
from lexloom.llm.anchors import SEGMENT, SPAN, WINDOW, sample
from lexloom.llm.hot import hot_join
from lexloom.llm.sieve import marked, sieve
from lexloom.session import Tables, cut, prepare, release

LEAST_BITS, MOST_BITS, HELD, FILE_ROWS = 20, 31, 1 << 17, 1 << 18
RANGES = np.array([[0, 15], [16, 30], [31, 45], [46, SPAN - 1]])


def bits_for(text_bytes: int) -> int:
    """Size of a bit set, a power of two."""
    return 1 << min(MOST_BITS, max(LEAST_BITS, (max(1, text_bytes) >> 4).bit_length()))


def _bits(keys: DataFrame, size: int) -> np.ndarray:
    """The bit set of a one-column DataFrame of longs; at most size / 64 words reach the driver."""
    k = keys.columns[0]
    at = keys.select(F.pmod(F.col(k), F.lit(size)).alias("p")).selectExpr("cast(p div 64 as int) as w", "shiftleft(1L, cast(p % 64 as int)) as b")
    table = at.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[table["w"].to_numpy()] = table["b"].to_numpy().view(np.uint64)
    return out


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    p = keys & np.uint64(64 * len(bits) - 1)
    return (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """doc_id, twin and start in its text of every document part, the sample, the bytes' start in the run, the bytes."""
    for batch in batches:
        ids, twins = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        data, off = K.column_bytes(batch.column(2))
        for i, j in K.chunks(off):
            if j - i == 1 and off[j] - off[i] > SEGMENT // 2:  # one very long text, in parts that share a window's length less one
                for a in range(int(off[i]), int(off[j]), SEGMENT // 2):
                    part = data[a : min(int(off[j]), a + SEGMENT // 2 + WINDOW - 1)]
                    yield ids[i:j], twins[i:j], np.array([a - off[i]]), sample(part, np.array([0, len(part)])), np.zeros(1, np.int64), part
            else:
                part = data[off[i] : off[j]]
                yield ids[i:j], twins[i:j], np.zeros(j - i, np.int64), sample(part, off[i : j + 1] - off[i]), off[i:j] - off[i], part


def _names(s: dict[str, np.ndarray]) -> np.ndarray:
    return K.mix(s["fp"] + s["ctx"] * K.COEF[2])


def _half(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, more: np.ndarray) -> np.ndarray:
    """32 bits of an independent hash of spans."""
    other = K.span_hash(K.prefix_hash(data, K.OTHER, 1), starts, ends, 1)
    return (K.mix(other + more * K.COEF[10]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _ident(k: np.ndarray, doc: np.ndarray, twin: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return k ^ (doc.view(np.uint64) << np.uint64(13)) ^ twin.view(np.uint64) ^ lo.astype(np.uint64)


def _ranges(s: dict[str, np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sample index, least and greatest offset, and core key of each offset range that has windows."""
    pos, lo, hi = (s[k][keep] for k in ("pos", "lo", "hi"))
    out = []
    for r, (a, b) in enumerate(RANGES.tolist()):
        least, most = np.maximum(a, pos - hi), np.minimum(b, pos - lo)
        ok = np.flatnonzero(least <= most)
        core = K.mix(K.span_hash(s["prefix"], pos[ok] - a, pos[ok] - b + WINDOW) + s["fp"][keep][ok] * K.COEF[3] + K.COEF[4 + r])
        out.append((keep[ok], least[ok], most[ok], core))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _counting(keys: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Keys with their counts (up to 2) in rows, some runs together."""

    def counted() -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(held).view(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.minimum(c, 2))], ["k", "c"])

    held, size = [], 0
    for k in keys:
        held.append(k)
        size += len(k)
        if size > HELD:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


def _scan(step: str, *sets: Broadcast):
    """A pass over the texts; ``sets`` are the bit sets of the passes before."""

    def opened(ids, twins, base, s, begin):
        """Sample indices that are open, and the names, documents and starts of all."""
        keep = np.flatnonzero(_has(sets[0].value, s["fp"]))
        d = s["doc"][keep]
        doc, twin, lo, k = ids[d], twins[d], base[d] + s["lo"][keep] - begin[d], _names({c: s[c][keep] for c in ("fp", "ctx")})
        if len(sets) > 1:
            ok = _has(sets[1].value, _ident(k, doc, twin, lo))
            keep, doc, twin, lo, k = keep[ok], doc[ok], twin[ok], lo[ok], k[ok]
        return keep, doc, twin, lo, k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counting(s["fp"] for _, _, _, s, _, _ in _runs(batches))

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counting(_ranges(s, opened(ids, twins, base, s, begin)[0])[3] for ids, twins, base, s, begin, _ in _runs(batches))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, twins, base, s, begin, data in _runs(batches):
            keep, doc, twin, lo, k = opened(ids, twins, base, s, begin)
            pos, first, last = s["pos"][keep], s["lo"][keep], s["hi"][keep]
            half = _half(data, first, last + WINDOW, ((pos - first) << 8 | (last - first)).astype(np.uint64))
            cols = (k.view(np.int64), half, s["fp"][keep].view(np.int64), doc, twin, lo.astype(np.int32), (last - first + WINDOW).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "k2", "fp", "doc_id", "twin", "lo", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, twins, base, s, begin, data in _runs(batches):
            keep, *_ = opened(ids, twins, base, s, begin)
            at, least, most, core = _ranges(s, keep)
            ok = _has(sets[2].value, core)
            at, least, most = at[ok], least[ok], most[ok]
            n = most - least + 1
            which = np.repeat(np.arange(len(at)), n)
            offset = least[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            start = s["pos"][at][which] - offset
            key = K.mix(K.span_hash(s["prefix"], start, start + WINDOW) + offset.astype(np.uint64) * K.COEF[9])
            d = s["doc"][at][which]
            cols = (key.view(np.int64), _half(data, start, start + WINDOW, offset.astype(np.uint64)), ids[d], twins[d], (start - begin[d] + base[d]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "k2", "doc_id", "twin", "lo"])

    return {"count": count, "cores": cores, "occurrences": occurrences, "windows": windows}[step]


def _later(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Rows that are not the first of their key; ``first`` has the keys found more than once with their first row and count."""
    return hot_join(rows, first, ["k", "k2"], "c").filter("not (doc_id = first.doc_id and twin = first.twin and lo = first.lo)")


def _among(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """Rows whose k may be among ``keys``, by their bit set: what is alone leaves before it is moved."""
    bits = rows.sparkSession.sparkContext.broadcast(_bits(keys.select("k"), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_has(bits.value, batch.column("k").to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def _span(end) -> Column:
    return F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR((F.col("lo") + end).cast("long")).alias("span")


def twins(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, twin, text and ``keep`` of every row: twin is 0, or tells rows of one doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    repeated = cut(docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"))
    twin = F.when(F.col("_may"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return marked(docs, "doc_id", repeated, "_may").select("doc_id", twin.alias("twin"), "text", *keep)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """doc_id, twin, spans (array of start << 32 | end) from ``twins``: bytes that an earlier string covers; overlapping spans are
    not merged, so a document has at most one for each of its bytes."""
    spark = prepare(texts.sparkSession)
    send, tables = spark.sparkContext.broadcast, Tables(spark)
    texts = texts.filter(f"doc_id is not null and octet_length(text) >= {WINDOW}")
    size = bits_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def twice(rows: DataFrame) -> DataFrame:
        return rows.groupBy("k").agg(F.sum("c").alias("c")).filter("c > 1").select("k")

    def firsts(rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy("k", "k2").agg(F.min(F.struct("doc_id", "twin", "lo")).alias("first"), F.count("*").alias("c"), *(F.min(m).alias(m) for m in more))

    strings = send(_bits(twice(texts.mapInArrow(_scan("count"), "k long, c long")), size))
    seen = tables.write("seen", texts.mapInArrow(_scan("occurrences", strings), "k long, k2 int, fp long, doc_id long, twin long, lo int, n int"))
    first = tables.write("first", firsts(seen, "fp").coalesce(1 + seen.count() // FILE_ROWS))
    several = first.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    ident = F.col("k").bitwiseXOR(F.shiftleft("first.doc_id", 13)).bitwiseXOR(F.col("first.twin")).bitwiseXOR(F.col("first.lo").cast("long"))
    open_ = send(_bits(sieve(first, "fp", several).select(ident.alias("k")), size))
    release(spark)
    repeated = first.filter("c > 1").drop("fp")
    again = tables.write("again", _among(seen.drop("fp"), repeated, size).coalesce(1 + seen.count() // FILE_ROWS))
    tables.drop("seen")
    whole = _later(again, repeated).select("doc_id", "twin", _span(F.col("n")))
    whole = tables.write("whole", whole.coalesce(1 + again.count() // FILE_ROWS))
    tables.drop("again", "first")

    cores = send(_bits(twice(texts.mapInArrow(_scan("cores", strings, open_), "k long, c long")), size))
    windows = tables.write("windows", texts.mapInArrow(_scan("windows", strings, open_, cores), "k long, k2 int, doc_id long, twin long, lo int"))
    least = tables.write("least", firsts(windows).filter("c > 1").coalesce(1 + windows.count() // FILE_ROWS))
    again = tables.write("close", _among(windows, least, size).coalesce(1 + windows.count() // FILE_ROWS))
    tables.drop("windows")
    single = _later(again, least).select("doc_id", "twin", _span(F.lit(WINDOW)))
    out = cut(whole.union(single).groupBy("doc_id", "twin").agg(F.collect_list("span").alias("spans")))
    tables.drop()
    return out


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n bytes lies in a span."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, spans >> 32, 1)
    np.add.at(step, spans & 0xFFFFFFFF, -1)
    return np.cumsum(step[:-1]) > 0


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = K.column_bytes(batch.column(2))
        out = []
        for i, spans in enumerate(batch.column(3)):
            text, spans = data[off[i] : off[i + 1]], spans.values.to_numpy()
            gone = covered(spans, len(text))
            left = text[~gone].tobytes()
            edges = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(gone.sum()), edges, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
            ["doc_id", "twin", "n_removed", "n_spans", "kept_sha256", "kept_text"],
        )


def remove_repeats(texts: DataFrame) -> DataFrame:
    """doc_id, twin, n_removed, n_spans, kept_sha256, kept_text of the rows of ``twins`` that lose bytes, once each
    (kept_text is without the rest of characters that were cut in two)."""
    spans = repeated_spans(texts.select("doc_id", "twin", "text"))
    some = sieve(texts, "doc_id", spans.select("doc_id")).join(spans, ["doc_id", "twin"]).select("doc_id", "twin", "text", "spans")
    out = some.mapInArrow(_removed, "doc_id long, twin long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out.dropDuplicates(["doc_id", "twin"])  # equal rows lose the same


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    texts = twins(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = texts.select("doc_id", "twin", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    both = rows.join(remove_repeats(texts).drop("kept_text"), ["doc_id", "twin"], "left")
    return both.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
