"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased code point by code point, everything but letters becomes one space, and the n-grams
of one to three characters inside a document are hashed to ``2**BITS`` features. Counts by language come
from labelled rows (at most about ``max_docs`` of them, drawn by a hash of doc_id: the one bound here);
the log-probability matrix is broadcast in blocks of ``BLOCK`` languages, 256 KB a language (``max_bytes`` bounds it: 2 GB are
8192 languages; more is an error before anything is sent), and whole texts are scored in numpy batches, a block at a time.

``score`` is the posterior of the predicted language. ``und`` with score 0: the text is null or has no
letter, or nothing could be learned. Ties go to the language that sorts first. Repeated rows count
again in training; null doc_ids are hashed as an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import kernel as K
from lexloom.session import prepare

BITS, ORDER, BLOCK, HELD = 16, 3, 16, 32
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@cache
def _folding() -> np.ndarray:
    """Code point -> its lower case, or 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _points(data: np.ndarray) -> np.ndarray:
    return _folding()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of a run of documents, each document's range among them, and whether it has a letter."""
    points = _points(data)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    ranges = heads[off]
    blank = points == 32
    solid = np.zeros(len(points) + 1, np.int64)
    np.cumsum(~blank, out=solid[1:])
    letters = np.diff(solid[ranges]) > 0
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    f, o = _grams(points[keep], np.repeat(np.arange(len(off) - 1), np.diff(at[ranges])))
    order = np.argsort(o, kind="stable")
    return f[order], np.searchsorted(o[order], np.arange(len(off))), letters


def _grams(points: np.ndarray, owner: np.ndarray, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of folded code points and whose they are; ``starts``: only those that begin before it."""
    found, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    h = np.zeros(len(points), np.uint32)
    for n in range(1, ORDER + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        h = (h[:m] + points[n - 1 : n - 1 + m]) * _MUL[n - 1]
        h ^= h >> np.uint32(15)
        ok = owner[:m] == owner[n - 1 : n - 1 + m]
        if n == 1:
            ok &= points[:m] != 32
        if starts is not None:
            ok[starts:] = False
        found.append(((h * _MUL[3]) >> np.uint32(32 - BITS))[ok].astype(np.int64))
        owners.append(owner[:m][ok])
    return np.concatenate(found), np.concatenate(owners)


def parts(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents i to j, their n-grams, ranges and whether they have a letter, in pieces of about the same work: a very long text comes
    several times, each with n-grams of its own, folded first and then hashed in blocks that share the last ORDER - 1 code points."""
    for i, j in K.chunks(off):
        if j - i > 1 or off[j] - off[i] <= K.LONG:
            yield i, j, *features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            continue
        text, folded, last, at = data[off[i] : off[j]], [], 0, 0
        while at < len(text):
            end = min(len(text), at + K.LONG)
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            points = _points(text[at:end])
            blank = points == 32
            folded.append(points[~(blank & np.concatenate([[last == 32], blank[:-1]]))])
            last, at = int(points[-1]), end
        points = np.concatenate(folded)
        letter = np.array([bool((points != 32).any())])
        for k in range(0, len(points), K.LONG // 4):
            block = points[k : k + K.LONG // 4 + ORDER - 1]
            f, _ = _grams(block, np.zeros(len(block), np.int64), K.LONG // 4)
            yield i, j, f, np.array([0, len(f)]), letter


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and feature, and documents (feature -1); at most HELD languages are held at a time."""
    totals: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, c in totals.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1)), pa.array(np.append(c[at], docs[lang]))], ["lang", "feature", "c"])
        totals.clear()
        docs.clear()

    for batch in batches:
        langs = batch.column(1).to_pylist()
        data, off = K.column_bytes(batch.column(0))
        seen = -1
        for i, j, f, ranges, _ in parts(data, off):
            for k in range(i, j):
                lang = langs[k]
                if lang not in totals:
                    if len(totals) >= HELD:
                        yield from counted()
                    totals[lang], docs[lang] = np.zeros(1 << BITS, np.int64), 0
                totals[lang] += np.bincount(f[ranges[k - i] : ranges[k - i + 1]], minlength=1 << BITS)
                docs[lang] += k > seen
                seen = max(seen, k)
    yield from counted()


def fit(labelled: DataFrame, max_docs: int = 20_000, alpha: float = 0.5, max_bytes: int = 1 << 31) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """Languages, log priors and the log-probability matrix (feature x language, in blocks of languages) from rows with doc_id, text and lang."""
    prepare(labelled.sparkSession)
    rows = labelled.filter("text is not null and lang is not null")
    n = rows.count()
    if n > max_docs:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))
    kinds = rows.agg(F.countDistinct("lang")).first()[0]
    if kinds * 4 << BITS > max_bytes:
        raise ValueError(f"{kinds} languages need more than {max_bytes} bytes")
    # at most max_bytes / 4 counts, by the test above
    counted = rows.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_counts, "lang string, feature long, c long").groupBy("lang", "feature").agg(F.sum("c").alias("c")).toPandas()
    groups = dict(tuple(counted.groupby("lang")))
    langs = sorted(groups)
    prior, blocks = np.zeros(len(langs)), []
    for first in range(0, len(langs), BLOCK):
        names = langs[first : first + BLOCK]
        matrix = np.zeros((1 << BITS, len(names)))
        for k, lang in enumerate(names):
            part = groups[lang]
            is_docs = part["feature"] < 0
            prior[first + k] = part.loc[is_docs, "c"].sum()
            matrix[part.loc[~is_docs, "feature"], k] = part.loc[~is_docs, "c"]
        blocks.append(np.log((matrix + alpha) / (matrix.sum(0) + alpha * (1 << BITS))).astype(np.float32))
    return langs, np.log(prior / max(1, prior.sum())), blocks


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, list[np.ndarray]]) -> DataFrame:
    """doc_id, lang_pred, score of every row; nothing but the text is looked at."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, blocks = shared.value
        for batch in batches:
            data, off = K.column_bytes(batch.column(1))
            n = len(off) - 1
            sums, known = np.zeros((n, max(1, len(langs)))), np.zeros(n, bool)
            for i, j, f, ranges, letters in parts(data, off):
                known[i:j] = letters & (len(langs) > 0)
                some = np.flatnonzero(np.diff(ranges) > 0)
                if len(langs) and len(some):
                    sums[i + some] += np.concatenate([np.add.reduceat(matrix[f], ranges[some], axis=0, dtype=np.float64) for matrix in blocks], 1)
            sums += prior if len(langs) else 0.0
            best = sums.argmax(1)
            top = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            names = [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, top, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def remainder(n: int) -> Column:
    """crc32 of the doc_id's digits modulo ``n``; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))
