"""Vectorised text primitives over Arrow string buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text and are hashed to 64 bits by a polynomial over
a random byte table (A-Z folds to a-z inside the table), so a batch of documents costs a few numpy
passes and no Python step per word. Work goes in chunks of about ``CHUNK`` bytes of whole documents, small enough
that a pass's arrays stay in the processor's cache; one longer document makes one longer chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 16
U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240917)
BYTES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
COEF = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
OTHER = _rng.integers(1, 2**64, 256, dtype=np.uint64)
#: Two independent bases: one hash nominates, both together decide.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash base and of its inverse, modulo 2**64."""
    size = CHUNK + CHUNK // 16
    while size < n:
        size *= 2
    if (size, which) not in _powers:
        if len(_powers) > 3:
            _powers.clear()
        out = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            a = np.full(size, base, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[size, which] = tuple(out)
    return _powers[size, which]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its n + 1 offsets from 0; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs, kind = col.buffers(), np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1))
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each document's range among them; no word crosses documents."""
    n = len(data)
    solid = ~_WS[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def prefix_hash(data: np.ndarray, table: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial prefix sums: ``span_hash`` gets any span's hash from them."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * powers(len(data) + 1, which)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return (prefix[ends] - prefix[starts]) * powers(len(prefix), which)[1][starts]


LONG = 1 << 22


def pieces_at_blanks(data: np.ndarray, size: int = LONG) -> Iterator[np.ndarray]:
    """A text in parts of about ``size`` bytes that end in front of a blank (one word is one part however long it is)."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data):
            near = np.flatnonzero(_WS[data[end : end + size]])
            if len(near):
                end += int(near[0])
                break
            end += size
        yield data[at : min(end, len(data))]
        at = end


def word_hashes(data: np.ndarray, off: np.ndarray, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """A well mixed 64-bit hash of every word, and each document's range among them. A very long text goes in parts: a word's hash does not depend on its place."""
    if len(off) == 2 and len(data) > LONG:
        h = np.concatenate([_word_hashes(part, np.array([0, len(part)]), table)[0] for part in pieces_at_blanks(data)])
        return h, np.array([0, len(h)])
    return _word_hashes(data, off, table)


def _word_hashes(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, ranges = words(data, off)
    return mix(span_hash(prefix_hash(data, table), starts, ends) + (ends - starts).astype(U64)), ranges


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Each document's sorted distinct hashes of ``width`` words in a row; shorter texts give their whole sequence."""
    h, ranges = word_hashes(data, off)
    full = max(0, len(h) - width + 1)
    s = np.zeros(full, U64)
    for k in range(width):
        s += h[k : k + full] * COEF[k]
    s = mix(s)
    for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(s[a : b - width + 1])
        elif b > a:
            yield mix((h[a:b] * COEF[: b - a]).sum(dtype=U64, keepdims=True) + COEF[width + b - a])
        else:
            yield s[:0]
