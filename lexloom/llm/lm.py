"""Language-model scoring with an Elias-Fano n-gram trie in the shared folder.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then one end for each document. Training rows give N (tokens),
V (distinct ones) and exact counts c. ``base_score`` sums log10((c + 1) / (N + V + 1)).

The model keeps every n-gram up to ``ORDER`` at every size: absolute discounting of what was seen, and back-off weights that
make a context's probabilities sum to one; a word outside training has the mass 1 / (N + V + 1) that is left. Words are told apart by
64-bit hashes; from there on a word is its number, and so is an n-gram, whose number is its place in its level.

The trie. Level 1 numbers the words by hash. A deeper level is one monotone sequence of (context's number, word's number), kept as
Elias-Fano does it: low bits packed, and a directory of monotone pointers by the high parts. A lookup starts at its context's pointer and
finds the word's successor there. Probabilities are quantised to steps of 1 / 4096 in log10, back-off weights to half floats, one for each
context. Levels are cut by context number into shards of about ``SHARD_BYTES`` of training text, so their number grows with
the input and a shard's size does not (but for one context with very many words after it, which stays in one shard). A shard is a file in
the shared folder that workers memory-map: nothing of the model is collected or broadcast.

Edge cases: null and empty texts have one token, the end; without training rows N = V = 0. Null doc_ids count as
an empty text in the crc32 rule; repeated rows count again; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import mmap
import os
import shutil
import struct
import uuid
import weakref
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import kernel as K
from lexloom.session import cut, folder, prepare, release

ORDER, SHARD_BYTES, DISCOUNT, FLUSH, RUN = 3, 1 << 24, 0.75, 1 << 21, 1 << 22
STEPS = 4096
END = np.uint64(0x5851F42D4C957F2D)


class Sequence:
    """An increasing sequence of 64-bit numbers: low bits packed, and for each high part a pointer to its first number."""

    @staticmethod
    def arrays(keys: np.ndarray) -> list[np.ndarray]:
        m, top = len(keys), int(keys[-1])
        low = min(56, (top // m).bit_length() + 2)  # about eight numbers a high part
        packed = [
            np.packbits(np.unpackbits(keys[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, count=low, bitorder="little").ravel(), bitorder="little")
            for i in range(0, m, 1 << 16)
        ]
        starts = np.searchsorted(keys >> np.uint64(low), np.arange((top >> low) + 2, dtype=np.uint64)).astype(np.uint32)
        return [np.array([m, low]), np.concatenate([*packed, np.zeros(8, np.uint8)]), starts]

    def __init__(self, meta: np.ndarray, packed: np.ndarray, starts: np.ndarray):
        self.m, self.low = map(int, meta)
        self.packed, self.starts = packed, starts

    def lows(self, i: np.ndarray) -> np.ndarray:
        """Low parts, from the bytes that hold them."""
        bit = i * self.low
        byte = bit >> 3
        word = np.zeros(len(i), np.uint64)
        for k in range((self.low + 14) // 8):
            word |= self.packed[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.starts, i, "right") - 1
        return high.astype(np.uint64) << np.uint64(self.low) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, -1 where it is missing: the successor among those with its high part decides."""
        high = (x >> np.uint64(self.low)).astype(np.int64)
        ok = high < len(self.starts) - 1
        high[~ok] = 0
        at, stop = self.starts[high].astype(np.int64), np.where(ok, self.starts[high + 1], 0).astype(np.int64)
        want, end = x & np.uint64((1 << self.low) - 1), stop.copy()
        todo = np.flatnonzero(at < stop)
        while len(todo):
            a, b = at[todo], stop[todo]
            mid = (a + b) >> 1
            less = self.lows(mid) < want[todo]
            at[todo], stop[todo] = np.where(less, mid + 1, a), np.where(less, b, mid)
            todo = todo[at[todo] < stop[todo]]
        out = np.full(len(x), -1, np.int64)
        there = np.flatnonzero(at < end)
        there = there[self.lows(at[there]) == want[there]]
        out[there] = at[there]
        return out


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Increasing keys as differences and their counts, byte by byte of each, compressed."""
    out = [struct.pack("<Q", len(keys))]
    for column in (np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint64)):
        width = (int(column.max()).bit_length() + 7) // 8
        out.append(struct.pack("<Q", width) + np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join(out))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = int(flat[:8].view(np.uint64)[0]), 8, []
    for _ in range(2):
        width = int(np.frombuffer(flat[at : at + 8].tobytes(), np.uint64)[0])
        column = np.zeros((n, 8), np.uint8)
        column[:, :width] = flat[at + 8 : at + 8 + n * width].reshape(width, n).T
        out.append(column.view(np.uint64).ravel())
        at += 8 + n * width
    return np.cumsum(out[0]), out[1]


def save(path: str, arrays: list[np.ndarray]) -> None:
    """One file; a task that runs again replaces it by the same."""
    with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(struct.pack("<Q", len(arrays)) + b"".join(struct.pack("<8sQ", a.dtype.str.encode(), a.nbytes) for a in arrays))
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(part, path)


def load(path: str) -> list[np.ndarray]:
    with open(path, "rb") as f:
        data = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)
    n = int(data[:8].view(np.uint64)[0])
    out, at = [], 8 + 16 * n
    for i in range(n):
        kind, size = struct.unpack("<8sQ", data[8 + 16 * i : 24 + 16 * i].tobytes())
        out.append(data[at : at + size].view(kind.rstrip(b"\0").decode()))
        at += size + -size % 8
    return out


class Level:
    """One order's files, mapped when a worker first asks for one. ``base`` has the number of the first n-gram of each shard, and all of them at its end.

    Level 1 is cut by the upper bits of word hashes; a deeper one gives each shard ``span`` contexts.
    """

    def __init__(self, at: str, order: int, shards: int, contexts: int = 0, words: int = 0):
        self.at, self.order, self.shards, self.words = f"{at}/{order}", order, shards, words
        self.span = max(1, -(-contexts // shards))
        self.base = np.zeros(shards + 1, np.int64)
        self.open: dict[int, tuple[Sequence, list[np.ndarray]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def place(self, context: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Shard and key of n-grams; in level 1 the context is the word's hash."""
        if self.order == 1:
            bits = np.uint64(65 - self.shards.bit_length())
            if bits == 64:
                return np.zeros(len(context), np.int64), context
            return (context >> bits).astype(np.int64), context & ((np.uint64(1) << bits) - np.uint64(1))
        s = context // self.span
        return s, (context - s * self.span).astype(np.uint64) * np.uint64(self.words) + word.astype(np.uint64)

    def within(self, s: np.ndarray) -> Iterator[tuple[Sequence, list[np.ndarray], int, np.ndarray]]:
        """Sequence, values, number and queries of each shard that is asked for and holds anything."""
        by = np.argsort(s.astype(np.uint16) if self.shards <= 1 << 16 else s, kind="stable")
        ends = np.searchsorted(s[by], np.arange(self.shards + 1))
        for shard in np.flatnonzero(np.diff(ends) * np.diff(self.base)).tolist():
            if shard not in self.open:
                arrays = load(f"{self.at}-{shard}")
                self.open[shard] = Sequence(*arrays[:3]), arrays[3:]
            yield *self.open[shard], shard, by[ends[shard] : ends[shard + 1]]

    def find(self, context: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Number of each n-gram (-1: never seen) and its value: a count in level 1, else the log10 of a probability."""
        s, keys = self.place(context, word)
        number, value = np.full(len(s), -1, np.int64), np.zeros(len(s))
        for sequence, (values, *_), shard, i in self.within(s):
            at = sequence.find(keys[i])
            i, at = i[at >= 0], at[at >= 0]
            number[i], value[i] = at + self.base[shard], values[at]
        return number, value if self.order == 1 else value / -STEPS

    def of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and stored value of n-grams by their numbers."""
        s = np.searchsorted(self.base, number, "right") - 1
        key, value = np.zeros(len(number), np.uint64), np.zeros(len(number))
        for sequence, (values, *_), shard, i in self.within(s):
            at = number[i] - self.base[shard]
            key[i], value[i] = sequence[at], values[at]
        return key, value

    def weight(self, context: np.ndarray) -> np.ndarray:
        """log10 of the back-off weight of contexts."""
        s = context // self.span
        out = np.zeros(len(s))
        for _, (_, weights), shard, i in self.within(s):
            out[i] = weights[context[i] - shard * self.span]
        return out


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a run's tokens with each document's end, and each document's range."""
    found, ranges = [], [np.zeros(1, np.int64)]
    for i, j in K.chunks(off):
        h, r = K.word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        found.append(np.insert(h, r[1:], END))
        ranges.append(ranges[-1][-1] + r[1:] + np.arange(1, j - i + 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(ranges)


def shifted(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1], x[:-1]])


def numbered(words: Level, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (-1: unknown) and count of each token; every distinct one is looked up once."""
    u, inverse = np.unique(h, return_inverse=True)
    number, count = words.find(u)
    return number[inverse], count[inverse]


def _grams(levels: list[Level], new: Level) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counted n-grams of the next order, in one packed row for each shard."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        s, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(s.astype(np.uint16) if new.shards <= 1 << 16 else s, kind="stable")
        ends = np.searchsorted(s[by], np.arange(new.shards + 1))
        some = np.flatnonzero(np.diff(ends))
        blobs = [pack(*np.unique(keys[by[ends[k] : ends[k + 1]]], return_counts=True)) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], ["s", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, off = K.column_bytes(batch.column(0))
            for i, j in K.chunks(off, RUN):
                h, ranges = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if new.order == 1:
                    held.append(new.place(h))
                else:
                    place = np.arange(len(h)) - np.repeat(ranges[:-1], np.diff(ranges))
                    word = numbered(levels[0], h)[0]
                    context = shifted(word)
                    for level in levels[1:]:
                        ok = np.flatnonzero(place >= level.order - 1)
                        gram = np.zeros(len(h), np.int64)
                        gram[ok] = level.find(context[ok], word[ok])[0]
                        context = shifted(gram)
                    ok = np.flatnonzero(place >= new.order - 1)
                    held.append(new.place(context[ok], word[ok]))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return count


def _build(levels: list[Level], new: Level, total: int) -> Callable[[pa.Table], pa.Table]:
    """Writes a shard's file; returns its number, tokens and distinct n-grams."""

    def lower(context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of words after their contexts less the first word; all of these n-grams were seen."""
        if new.order == 2:
            return (levels[0].of(word)[1] + 1) / total
        last = (levels[-1].of(context)[0] % np.uint64(new.words)).astype(np.int64)
        return 10.0 ** levels[1].find(last, word)[1]

    def build(table: pa.Table) -> pa.Table:
        s, parts = table["s"][0].as_py(), [unpack(blob.as_py()) for blob in table["data"]]
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, c = keys[first], np.add.reduceat(counts, first).astype(np.int64)
        if new.order == 1:
            values = [c.astype(np.uint32 if c.max() < 1 << 32 else np.uint64)]
        else:
            local, word = (x.astype(np.int64) for x in np.divmod(keys, np.uint64(new.words)))
            seen = (c - DISCOUNT) / np.bincount(local, c, new.span)[local]
            left, under = 1 - np.bincount(local, seen, new.span), 1 - np.bincount(local, lower(local + s * new.span, word), new.span)
            weights = np.log10(np.maximum(left, 1e-9) / np.maximum(under, 1e-9))
            values = [np.minimum(np.rint(np.log10(seen) * -STEPS), 65535).astype(np.uint16), weights.astype(np.float16)]
        save(f"{new.at}-{s}", Sequence.arrays(keys) + values)
        return pa.table({"s": pa.array([s], pa.int32()), "n": pa.array([int(c.sum())]), "v": pa.array([len(keys)])})

    return build


class Model:
    """The levels, N, V and the number of n-grams of each order; the files go with the object."""

    def __init__(self, at: str):
        self.at, self.levels, self.sizes, self.n = at, [], [], 0
        weakref.finalize(self, shutil.rmtree, at, ignore_errors=True)

    @property
    def v(self) -> int:
        return self.sizes[0]

    @property
    def total(self) -> int:
        return self.n + self.v + 1


def shared_folder(spark: SparkSession) -> str:
    """A new folder by its path, which workers open themselves."""
    at = urlparse(folder(spark))
    if at.scheme not in ("", "file"):
        raise ValueError("the language model's files need spark.checkpoint.dir on a file system that workers have mounted")
    os.makedirs(new := f"{at.path}/lm-{uuid.uuid4().hex}")
    return new


def train(texts: DataFrame) -> Model:
    """The model of a one-column DataFrame of texts."""
    spark = prepare(texts.sparkSession)
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    model, shards = Model(shared_folder(spark)), 1 << math.ceil(math.log2(max(1, size / SHARD_BYTES)))
    for order in range(1, ORDER + 1):
        new = Level(model.at, order, shards, model.sizes[-1], model.v) if order > 1 else Level(model.at, 1, shards)
        rows = texts.mapInArrow(_grams(model.levels, new), "s int, data binary").groupBy("s")
        done = rows.applyInArrow(_build(model.levels, new, model.total if order > 1 else 0), "s int, n long, v long").collect()  # one row for each shard
        sizes = np.zeros(shards, np.int64)
        sizes[[r["s"] for r in done]] = [r["v"] for r in done]
        new.base[1:] = np.cumsum(sizes)
        model.levels.append(new)
        model.sizes.append(int(sizes.sum()))
        if order == 1:
            model.n = sum(r["n"] for r in done)
        del rows
        release(spark)
    return model


def log10(levels: list[Level], h: np.ndarray, ranges: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Count of each token, and its log10 probability after up to two tokens of its document."""
    word, c = numbered(levels[0], h)
    out = np.log10((c + 1) / total)
    later = np.ones(len(h), bool)
    later[ranges[:-1]] = False
    gram = word
    for level in levels[1:]:
        before = shifted(gram)
        ask = np.flatnonzero(later & (before >= 0))
        out[ask] += level.weight(before[ask])
        ask = ask[word[ask] >= 0]
        number, value = level.find(before[ask], word[ask])
        gram = np.full(len(h), -1, np.int64)
        gram[ask] = number
        out[ask[number >= 0]] = value[number >= 0]
    return c, out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row; ``docs`` has doc_id and text."""
    levels, n, total = model.levels, model.n, model.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.column_bytes(batch.column(1))
            for i, j in K.chunks(off, RUN):
                h, ranges = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                c, value = log10(levels, h, ranges, total)
                heads = ranges[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(ranges)), pa.array(np.add.reduceat((c > 0).astype(np.int64), heads)), pa.array(np.full(j - i, n, np.int64)), pa.array(np.add.reduceat(np.log10((c + 1) / total), heads)), pa.array(np.add.reduceat(value, heads))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    # written at once, as the model's files may be gone when the rows are asked for
    return cut(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
