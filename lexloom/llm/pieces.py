"""SentencePiece encoding and decoding by Viterbi over a public piece vocabulary.

Ids are those of the segmentation whose pieces' scores have the greatest sum, as a SentencePiece unigram
model finds it (a tie keeps the earliest start of the last piece). A space is the pieces' word mark, a
text gets one in front, and characters without a piece become their UTF-8 byte pieces, so decoding
gives back every text exactly (U+2581 itself is spelt in bytes for that reason).

The recurrence streams: a boundary's best score needs the last ``longest`` boundaries only, so a window of that many is its whole
state, and once all paths that still survive in the window pass through one boundary, everything before it is final and committed.
Since no piece has a word mark behind a letter (checked when a vocabulary is loaded), paths always converge in front of a space that
follows one. So a text is a row of segments that begin there, and a numpy step of the recurrence serves one byte of many distinct segments.
A segment above 256 bytes is streamed in blocks of 192 side by side: a block starts 64 bytes early (both grow with the longest piece), from
nothing, and counts as soon as its window is the same as that of the block before it, which has to count itself; else it is run again from that window. A
block's ids are committed when all surviving paths of the next one enter it by one boundary, else when the block after that has been.
Scores are whole numbers (steps of 2**-20), so windows are equal or not, and do not depend on where a block began.

The vocabulary is read from a file on the driver and broadcast (its size is that of the file). Null text
gives null ids, an empty one an empty list; repeated rows and extra columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame

from lexloom.llm import kernel as K
from lexloom.session import prepare

MARK = "▁"
WARM, LANES, CHUNK, UNKNOWN, UNIT = 64, 4096, 1 << 19, 10.0, 1 << 20
NEVER, GROW = -(1 << 61), 0x9E3779B97F4A7C15


class Vocabulary:
    """Pieces in the text's own bytes (word mark as a space), their scores, and the ids of single bytes."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], size: int):
        self.flat: list[bytes] = [b""] * size
        self.scores: dict[bytes, tuple[float, int]] = {}
        for i, piece, score in pieces:
            raw = piece.replace(MARK, " ").encode()
            self.flat[i] = raw
            self.scores[raw] = (score, i)
        for b, i in enumerate(byte_ids):
            self.flat[i] = bytes([b])
        self.byte_ids = np.array(byte_ids, np.int32)
        self.unknown = min(s for s, _ in self.scores.values()) - UNKNOWN
        if crossing := [p for p in self.scores if b" " in p.lstrip(b" ")]:
            raise ValueError(f"pieces with a word mark behind a letter, such as {crossing[0]!r}")
        self.longest = max(map(len, self.scores))
        self.warm = max(WARM, 2 * self.longest)
        self.block = 3 * self.warm
        self.cost_unknown = round(self.unknown * UNIT)
        # every ending of a piece, read from its last byte: how to score it if it is a piece, and whether a longer one has it as its ending
        ends: dict[bytes, tuple[int, int, bool]] = {}
        for p, (score, i) in self.scores.items():
            for k in range(1, len(p)):
                old = ends.get(p[k:], (NEVER, 0, False))
                ends[p[k:]] = (old[0], old[1], True)
            ends[p] = (round(score * UNIT), i, ends.get(p, (0, 0, False))[2])
        self.bits = max(16, (4 * len(ends)).bit_length())
        size = 1 << self.bits
        self.table, self.value, self.ident, self.more = np.zeros(size, np.uint64), np.full(size, NEVER), np.zeros(size, np.int32), np.zeros(size, bool)
        self.probes = 1
        for p, found in ends.items():
            key = 0
            for byte in reversed(p):
                key = (key * GROW + int(K.BYTES[byte])) & (2**64 - 1)
            at, step = key >> (64 - self.bits), 1
            while self.table[at]:
                if int(self.table[at]) == key:
                    raise ValueError("two pieces have one hash")
                at, step = (at + 1) & (size - 1), step + 1
            self.table[at], (self.value[at], self.ident[at], self.more[at]) = key, found
            self.probes = max(self.probes, step)
        lens = np.array([len(p) for p in self.flat])
        self.piece_off, self.piece_len = np.concatenate([[0], np.cumsum(lens)]), lens
        self.piece_bytes = np.frombuffer(b"".join(self.flat), np.uint8)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        plain = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        by_byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        if len(by_byte) != 256:
            raise ValueError("the vocabulary has no piece for every byte")
        return cls(plain, [by_byte[b] for b in range(256)], sp.vocab_size())

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score (NEVER: no piece), id, and whether a longer ending may follow, for hashes of endings."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = self.table[at]
        for _ in range(self.probes - 1):
            miss = np.flatnonzero((hit != h) & (hit != 0))
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & (len(self.table) - 1)
            hit[miss] = self.table[at[miss]]
        ok = hit == h
        return np.where(ok, self.value[at], NEVER), self.ident[at], self.more[at] & ok


class Lanes:
    """Stretches of text side by side, a byte of each at a time. Row r of a lane is the boundary in front of its byte r."""

    def __init__(self, v: Vocabulary, data: np.ndarray, heads: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.v, self.begin, self.end = v, begin, end
        rows, n = int(end.max()), len(at)
        where = np.clip(at + np.arange(rows + 1)[:, None], 0, len(data) - 1)  # data ends with a byte that is none
        self.text = data[where[:-1]]
        self.bound = heads[where]  # whether a character begins there
        self.best = np.full((rows + 1, n), NEVER)
        self.best[begin, np.arange(n)] = 0
        self.step = np.ones((rows + 1, n), np.int16)
        self.ident = np.zeros((rows + 1, n), np.int32)
        self.ident[1:] = v.byte_ids[self.text]  # what an unknown character's bytes become, one step each

    def run(self, lanes: np.ndarray, first: int) -> None:
        """The recurrence for some lanes, from row ``first`` on."""
        v, text, best = self.v, self.text, self.best
        begin, end = self.begin[lanes], self.end[lanes]
        last = np.maximum(begin, first - 1 - self.bound[first - 1 :: -1, lanes].argmax(0))  # the last boundary so far
        for e in range(first, int(end.max()) + 1 if len(lanes) else 0):
            on = np.flatnonzero((e > begin) & (e <= end) & self.bound[e, lanes])
            if not len(on):
                continue
            at, before = lanes[on], last[on]
            top, size, which = np.full(len(on), NEVER), np.ones(len(on), np.int16), self.ident[e, at].copy()
            alone = np.zeros(len(on), bool)
            act, lane, h = np.arange(len(on)), at, np.zeros(len(on), np.uint64)
            for length in range(1, min(v.longest, e) + 1):
                s = e - length
                h = h * np.uint64(GROW) + K.BYTES[text[s, lane]]
                score, i, more = v.look_up(h)
                total = best[s, lane] + score
                alone[act] |= (score > NEVER) & (before[act] == s)
                better = np.flatnonzero((total > NEVER) & (total >= top[act]))  # the longer of equal ones
                top[act[better]], size[act[better]], which[act[better]] = total[better], length, i[better]
                more &= begin[on[act]] < s
                act, lane, h = act[more], lane[more], h[more]
                if not len(act):
                    break
            raw = best[before, at] + v.cost_unknown
            unknown = ~alone & (raw > top)
            best[e, at], self.step[e, at] = np.where(unknown, raw, top), np.where(unknown, 1, size)
            self.ident[e, at] = np.where(unknown, self.ident[e, at], which)
            last[on] = e

    def window(self, lanes: np.ndarray, row: int) -> np.ndarray:
        """Best scores of the last ``longest`` boundaries, against the best of them."""
        w = self.best[row - self.v.longest : row + 1, lanes]
        return np.where(w > NEVER, w - w.max(0), NEVER)

    def ids(self, exits: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids on the way from each lane's exit back to its entry, lane by lane, and their number."""
        at, row, out, count = exits.copy(), np.arange(len(exits)), [], np.zeros(len(exits), np.int64)
        row = row[at > entries]
        while len(row):
            here = at[row]
            out.append((row, self.ident[here, row]))
            count[row] += 1
            at[row] = here - self.step[here, row]
            row = row[at[row] > entries[row]]
        if not out:
            return np.zeros(0, np.int32), count
        rows, ids = np.concatenate([r for r, _ in out]), np.concatenate([i for _, i in out])
        depth = np.repeat(np.arange(len(out)), [len(r) for r, _ in out])
        flat = np.empty(len(ids), np.int32)
        flat[np.cumsum(count)[rows] - 1 - depth] = ids  # back pointers give the last id first
        return flat, count


def _short(v: Vocabulary, data: np.ndarray, heads: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of segments of one lane each, and each one's count."""
    lanes = Lanes(v, data, heads, starts, np.zeros(len(starts), np.int64), lens)
    lanes.run(np.arange(len(starts)), 1)
    return lanes.ids(lens, np.zeros(len(starts), np.int64))


def _long(v: Vocabulary, data: np.ndarray, heads: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of segments that are streamed in blocks, and each one's count."""
    warm, block = v.warm, v.block
    blocks = -(-lens // block)
    which = np.repeat(np.arange(len(starts)), blocks)
    k = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    end = warm + np.minimum(block, lens[which] - k * block)
    lanes = Lanes(v, data, heads, starts[which] + k * block - warm, np.where(k == 0, warm, 0), end)
    lanes.run(np.arange(len(which)), 1)
    follow = np.flatnonzero(k > 0)
    while True:
        same = np.zeros(len(which), bool)
        same[follow] = (lanes.window(follow, warm) == lanes.window(follow - 1, warm + block)).all(0)
        head = np.flatnonzero(~same)  # the blocks behind it that agree one with the other count if it does
        good = (k[head] == 0)[np.cumsum(~same) - 1]
        again = np.flatnonzero(~good & ~same & np.concatenate([[False], good[:-1]]))
        if not len(again):
            break
        lanes.best[: warm + 1, again], lanes.best[warm + 1 :, again] = lanes.best[block : warm + block + 1, again - 1], NEVER
        lanes.begin[again] = 0
        lanes.run(again, warm + 1)
    rows, n = lanes.best.shape
    entry = np.tile(np.arange(rows, dtype=np.int64)[:, None], (1, n))  # the boundary up to warm that the way to a row passes
    every = np.arange(n)
    for e in range(warm + 1, rows):
        entry[e] = entry[e - lanes.step[e], every]
    exits, entries = end.copy(), np.full(n, warm)
    live = lanes.best[-v.longest - 1 :] > NEVER
    inner = entry[-v.longest - 1 :]
    low, high = np.where(live, inner, rows).min(0), np.where(live, inner, -1).max(0)
    converged = (low == high) & (end == warm + block)
    entries[follow] = np.where(converged[follow], low[follow], -1)
    for lane in reversed(follow.tolist()):
        if entries[lane] < 0:
            entries[lane] = entry[exits[lane], lane]
        exits[lane - 1] = entries[lane] + block
    flat, count = lanes.ids(exits, entries)
    return flat, np.bincount(which, count, len(starts)).astype(np.int64)


def encode_run(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of documents, flat, and n + 1 offsets."""
    full = np.flatnonzero(np.diff(off) > 0)
    data = np.insert(data, off[full], 32)
    shift = np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
    off = off + shift
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    space = data == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[off[full]] = True  # each document begins with one
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))
    key = K.mix(K.span_hash(K.prefix_hash(data, K.BYTES), starts, ends) + (ends - starts).astype(np.uint64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    s, lens = starts[first], (ends - starts)[first]
    counts, pieces, seen = np.zeros(len(first), np.int64), [], []
    order = np.argsort(lens, kind="stable")
    cuts = np.searchsorted(lens[order], [9, 13, 17, 25, 33, 65, 129, v.warm + v.block + 1])
    groups = [(_short, order[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] + [(_long, order[cuts[-1] :])]
    heads = np.append((data & 0xC0) != 0x80, True)
    data = np.append(data, np.uint8(0))
    for solve, all_ in groups:
        lanes = np.cumsum(-(-lens[all_] // v.block)) // LANES
        for group in np.split(all_, np.flatnonzero(np.diff(lanes)) + 1) if len(all_) else []:
            flat, counts[group] = solve(v, data, heads, s[group], lens[group])
            pieces.append(flat)
            seen.append(group)
    flat, seen = np.concatenate(pieces), np.concatenate(seen)
    place = np.zeros(len(first), np.int64)
    place[seen] = np.concatenate([[0], np.cumsum(counts[seen])[:-1]])
    n = counts[which]
    total = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(place[which] - total[:-1], n) + np.arange(total[-1])]
    return ids, total[np.searchsorted(starts, off)]


def decode_run(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that ids stand for, flat, and n + 1 offsets."""
    lens = v.piece_len[ids]
    total = np.concatenate([[0], np.cumsum(lens)])
    data = v.piece_bytes[np.repeat(v.piece_off[ids] - total[:-1], lens) + np.arange(total[-1])]
    heads = off[:-1][np.diff(off) > 0]
    data = np.delete(data, total[heads])  # the mark in front
    return data, total[off] - np.concatenate([[0], np.cumsum(np.diff(off) > 0)])


def _encoder(shared: Broadcast, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(keep) + 1)
            data, off = K.column_bytes(text)
            for i, j in K.chunks(off, CHUNK):
                ids, ends = encode_run(shared.value, data[off[i] : off[j]], off[i : j + 1] - off[i])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(text.slice(i, j - i).is_null().to_numpy(zero_copy_only=False), False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), lists], ["doc_id", *keep, "ids"])

    return run


def _decoder(shared: Broadcast, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep) + 1)
            sizes = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([len(x) if x.is_valid else 0 for x in lists])
            off = np.concatenate([[0], np.cumsum(sizes)])
            ids = lists.flatten().to_numpy()
            for i, j in K.chunks(off, 1 << 17):
                data, ends = decode_run(shared.value, ids[off[i] : off[j]], off[i : j + 1] - off[i])
                texts = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                texts = pa.compute.if_else(lists.slice(i, j - i).is_null(), pa.scalar(None, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), texts], ["doc_id", *keep, "ids", "text"])

    return run


def _apply(df: DataFrame, run, keep: tuple[str, ...], read: str, made: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("doc_id", *keep, read).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", " + made)


def _shared(df: DataFrame, path: str) -> Broadcast:
    return prepare(df.sparkSession).sparkContext.broadcast(Vocabulary.load(path))


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` and ids (array of int) for every row."""
    return _apply(docs, _encoder(_shared(docs, path), keep), keep, "text", "ids array<int>")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, ids and text for rows with ids."""
    return _apply(encoded, _decoder(_shared(encoded, path), keep), keep, "ids", "ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, ids and the text that the ids decode to: ``decode`` of ``encode``, in one worker a task instead of two."""
    shared = _shared(docs, path)
    there, back = _encoder(shared, keep), _decoder(shared, keep)
    return _apply(docs, lambda batches: back(there(batches)), keep, "text", "ids array<int>, text string")
