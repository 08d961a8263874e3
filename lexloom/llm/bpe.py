"""Byte-level BPE: encoding by merge ranks, and decoding.

A text is cut into pre-tokens by a pattern. Each pre-token's bytes are a linked list, and every pair of
neighbours that the rank table knows lies in the bucket of its rank. A bitmap of two levels tells which
buckets are filled: find-first-set on the upper word, then on the lower one, gives the least rank. Its
positions are merged from left to right; a position whose pair has changed since is stale and skipped. A
merge costs two look-ups whatever the length, so a pre-token of n bytes costs O(n) steps, and no length is
treated in another way. The state takes about 40 bytes for each byte of the longest pre-token.

Short stretches between blanks are remembered in each worker (two generations of at most ``MEMO``), and long texts are worked on
in blocks that end between two pre-tokens, so what a task holds is its batch, one block's pre-tokens and the ids.

Edge cases: a null text has null ids, an empty one none; null doc_ids, repeated rows and further columns are
ordinary; an empty table gives an empty result; one pre-token may be a whole text of any length.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexloom.session import prepare

#: Stretches in a generation that a worker remembers, their greatest length, characters of a block, ids of a batch that is sent back.
MEMO, SHORT, BLOCK, IDS = 1 << 19, 48, 1 << 20, 1 << 20


class Memo(dict):
    """Values by key, made when missing. Long keys are not kept; a full memo becomes the older generation, from which what is asked for
    again comes back."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= SHORT:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


BIT = [1 << k for k in range(256)]


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Ids of one pre-token: the pair of least rank merges first, the leftmost of equal ones."""
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    after, before, rank = range(1, n + 1), range(-1, n - 1), [-1] * n  # rank: of the pair that starts here, -1: none
    after, before, rank = (list(after), list(before), rank) if n < 4096 else (array("q", after), array("q", before), array("q", rank))
    buckets: dict[int, list[int]] = {}
    lower: dict[int, int] = {}
    upper = 0
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            rank[i] = r
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                word = r >> 8
                if word in lower:
                    lower[word] |= BIT[r & 255]
                else:
                    lower[word] = BIT[r & 255]
                upper |= BIT[word] if word < 256 else 1 << word
    while upper:
        word = (upper & -upper).bit_length() - 1
        bits = lower[word]
        first = bits & -bits
        r = word << 8 | first.bit_length() - 1
        if bits == first:
            del lower[word]
            upper &= upper - 1
        else:
            lower[word] = bits ^ first
        positions = buckets.pop(r)
        if len(positions) == 1:
            if rank[positions[0]] != r:
                continue  # stale
        else:
            positions.sort()
        for at, i in enumerate(positions):
            if rank[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i], rank[i], rank[j] = k, -1, -1
            sooner = False
            p = before[i]
            if k < n:
                before[k] = i
                if (new := get(piece[i : after[k]], -1)) >= 0:
                    rank[i] = new
                    sooner = new < r
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        word = new >> 8
                        lower[word] = lower.get(word, 0) | BIT[new & 255]
                        upper |= BIT[word] if word < 256 else 1 << word
            if p >= 0:
                rank[p] = new = get(piece[p:k], -1)
                if new >= 0:
                    sooner = sooner or new < r
                    if new in buckets:
                        buckets[new].append(p)
                    else:
                        buckets[new] = [p]
                        word = new >> 8
                        lower[word] = lower.get(word, 0) | BIT[new & 255]
                        upper |= BIT[word] if word < 256 else 1 << word
            if sooner and at + 1 < len(positions):  # a lesser rank has come up: it goes first
                buckets[r] = positions[at + 1 :]
                word = r >> 8
                lower[word] = lower.get(word, 0) | BIT[r & 255]
                upper |= 1 << word
                break
    ids, i = [], 0
    while i < n:
        k = after[i]
        ids.append(ranks[piece[i:k]])
        i = k
    return ids


@dataclass
class Coder:
    """A rank table with its pattern. ``at_spaces``: no pre-token has a non-blank before a blank, and none looks behind itself, so a
    text may be cut in front of every blank that follows a non-blank."""

    ranks: dict[bytes, int]
    pattern: str
    at_spaces: bool = True
    ready: bool = field(default=False, repr=False)

    @classmethod
    def load(cls, path: str, pattern: str, at_spaces: bool = True) -> Coder:
        """From a file of lines "base64 rank"."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern, at_spaces)

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "at_spaces": self.at_spaces, "ready": False}

    def _get_ready(self) -> None:
        """Once a worker: the pattern, the bytes of each id and what is remembered."""
        split = regex.compile(self.pattern).findall
        pieces = Memo(lambda piece: packed(merge(self.ranks, piece.encode())))
        self.stretch = Memo(lambda s: b"".join(map(pieces.__getitem__, split(s))))

        def of_word(s: str) -> bytes:
            """Ids of a blank and what stands between it and the next one. Pieces that are a blank and a word are remembered by the word."""
            parts = (s,) if s.isalpha() else split(" " + s)  # letters are one piece
            if len(parts) == 1:
                return packed(merge(self.ranks, b" " + s.encode()))
            return b"".join(self.after_space[x[1:]] if x[0] == " " and len(x) > 1 else pieces[x] for x in parts)

        self.after_space = Memo(of_word)
        self.cut = regex.compile(r"\s*\S+|\s+").findall if self.at_spaces else lambda s: [s]
        blanks = regex.findall(r"\s", "".join(map(chr, [*range(0x3100)])))
        self.double = [b + " " for b in blanks]
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for b, i in self.ranks.items():
            self.lengths[i] = len(b)
        self.places = np.cumsum(self.lengths) - self.lengths
        gc.set_threshold(100_000)  # merging makes many small lists and no cycles
        self.bytes_of = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)
        self.ready = True

    def _blocks(self, text: str) -> Iterator[str]:
        """Parts of a text of about BLOCK characters, each ending between two pre-tokens."""
        start = 0
        while self.at_spaces and len(text) - start > BLOCK:
            at = start + BLOCK
            while (at := text.find(" ", at)) > 0 and text[at - 1].isspace():
                at += 1
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def encode(self, text: str) -> np.ndarray:
        if not self.ready:
            self._get_ready()
        out = []
        for block in self._blocks(text):
            if self.at_spaces and not any(d in block for d in (self.double[:6] if block.isascii() else self.double)):
                head, *rest = block.split(" ")
                if rest and head:
                    parts = chain(map(self.stretch.__getitem__, [head]), map(self.after_space.__getitem__, rest))
                else:
                    parts = map(self.after_space.__getitem__, rest) if rest else map(self.stretch.__getitem__, [head])
            else:
                parts = map(self.stretch.__getitem__, self.cut(block))
            out.append(b"".join(parts))
        return np.frombuffer(out[0] if len(out) == 1 else b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        if not self.ready:
            self._get_ready()
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.bytes_of[np.repeat(self.places[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def _lists(items: list, flat: pa.Array) -> pa.Array:
    """A list array of the items' lengths over ``flat``; null where an item is None."""
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in items)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.array([*(x is None for x in items), False])), flat)


def _run(shared, keep: tuple[str, ...], decoded: bool, given: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            values, start = batch.column(len(keep) + 1), 0
            ids, back, size = [], [], 0
            for i, value in enumerate(values):
                if given == "text":
                    one = value.as_py()
                    ids.append(None if one is None else coder.encode(one))
                else:
                    ids.append(value.values.to_numpy(zero_copy_only=False) if value.is_valid else None)
                if decoded:
                    back.append(None if ids[-1] is None else coder.decode(ids[-1]))
                size += 0 if ids[-1] is None else len(ids[-1])
                if size >= IDS or i + 1 == len(values):
                    full = [x for x in ids if x is not None]
                    lists = _lists(ids, pa.array(np.concatenate(full) if full else np.zeros(0, np.int32), pa.int32()))
                    made = [lists, pa.array(back, pa.binary())] if decoded else [lists]
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, i + 1 - start) for c in batch.columns[:-1]), *made], ["doc_id", *keep, "ids", "decoded"][: len(keep) + 1 + len(made)])
                    ids, back, size, start = [], [], 0, i + 1

    return run


def _apply(df: DataFrame, coder: Coder, keep: tuple[str, ...], given: str, decoded: bool) -> DataFrame:
    kinds = dict(df.dtypes)
    shared = prepare(df.sparkSession).sparkContext.broadcast(coder)  # a vocabulary file's size
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", ids array<int>" + ", decoded binary" * decoded
    return df.select("doc_id", *keep, given).mapInArrow(_run(shared, keep, decoded, given), schema)


def encode(docs: DataFrame, coder: Coder, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` and ids (array of int) for every row."""
    return _apply(docs, coder, keep, "text", False)


def decode(encoded: DataFrame, coder: Coder, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, ids and the bytes that they stand for, in ``decoded``; cast to string where ids make up whole characters."""
    return _apply(encoded, coder, keep, "ids", True)


def round_trip(docs: DataFrame, coder: Coder, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, ids and the bytes that the ids decode to: ``decode`` of ``encode``, in one worker a task instead of two."""
    return _apply(docs, coder, keep, "text", True)
