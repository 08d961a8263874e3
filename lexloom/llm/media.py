"""Media columns: PNG bytes in a binary column, read back with checks, and a low-frequency cosine hash.

A payload (bytes, padded with 0 to a positive multiple of 64) is stored losslessly as an 8-bit grey image,
64 samples wide. Reading back walks the zlib-compressed chunks, tests every checksum, undoes all five
PNG filters in numpy and refuses what is malformed. The feature is 64 bits: the image is averaged to
32 x 32, its two-dimensional cosine transform's 8 x 8 lowest frequencies are compared with their
median (the constant term apart), as hex.

Null and empty texts give one row of zeros. Equal texts give equal values; repeated rows and extra
columns do not matter; an empty table gives an empty result. Work is by document, so memory is a
small multiple of the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm import kernel as K
from lexloom.session import prepare

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_k = np.arange(32)
_COSINE = np.cos(np.pi * (2 * _k[None] + 1) * _k[:8, None] / 64)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit grey image; the filter (none, left or above) with the least sum of absolute residuals serves all rows."""
    h, w = samples.shape
    left, above = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    above[1:] -= samples[:-1]
    choices = (samples, left, above)
    kind = min(range(3), key=lambda k: int(np.abs(choices[k].view(np.int8).astype(np.int16)).sum()))
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, choices[kind]
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo PNG row filters, one byte a sample. Runs of rows with filter 0, 1 or 2 take one numpy call each."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown PNG filter")
    stops = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *stops.tolist()], [*stops.tolist(), len(kinds)], strict=True):
        kind = kinds[a] if len(kinds) else 0
        before = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            out[a] += before
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind >= 3:
            for r in range(a, b):
                up = (out[r - 1] if r else before).astype(int)
                line, was_left, was_corner = out[r], 0, 0
                for x in range(len(line)):
                    if kind == 3:
                        guess = (was_left + int(up[x])) // 2
                    else:
                        p = was_left + int(up[x]) - was_corner
                        guess = min((was_left, int(up[x]), was_corner), key=lambda v: abs(p - v))
                    was_corner = int(up[x])
                    was_left = (int(line[x]) + guess) & 255
                    line[x] = was_left
    return out


def read_png(png: bytes) -> np.ndarray:
    """Samples of an 8-bit grey, not interlaced PNG; ValueError for anything damaged."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, body, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(data) < n or at + 12 + n > len(png):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            w, h, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", data)
            if (depth, colour, method, filters, interlace) != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit grey without interlace")
            size = h, w
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
    if size is None:
        raise ValueError("no header")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != size[0] * (size[1] + 1):
        raise ValueError("wrong number of samples")
    return _unfilter(raw.reshape(size[0], size[1] + 1))


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits of an image's low frequencies, as 16 hex digits."""
    if samples.shape[0] < 32:
        samples = np.repeat(samples, -(-32 // samples.shape[0]), axis=0)
    edges = np.arange(32) * samples.shape[0] // 32
    bands = np.add.reduceat(samples.astype(np.int64), edges, axis=0) / np.diff(np.append(edges, samples.shape[0]))[:, None]
    cells = bands.reshape(32, 32, samples.shape[1] // 32).mean(2)
    low = (_COSINE @ cells @ _COSINE.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = K.column_bytes(batch.column(1))
        for i, j in K.chunks(off):
            out = []
            for a, b in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True):
                samples = np.zeros(max(1, -(-(b - a) // WIDTH)) * WIDTH, np.uint8)
                samples[: b - a] = data[a:b]
                out.append(write_png(samples.reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (PNG bytes) for every row."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_payloads, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for png in batch.column(2):
            png = png.as_py()
            samples = read_png(png)
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def describe_media(media: DataFrame) -> DataFrame:
    """Reads every stored image back: doc_id, n_bytes, payload and media digests, feature."""
    prepare(media.sparkSession)
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_described, f"doc_id {dict(media.dtypes)['doc_id']}, {schema}")
