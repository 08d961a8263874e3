"""Content-chosen sample positions of byte strings.

Every window of ``WINDOW`` bytes names one anchor: the leftmost of its ``GRAM``-byte strings with the least hash.
Equal windows name equal anchors at equal offsets, so only windows of equal anchors can be equal: the sample plays the part that
positions modulo three play in the difference-cover algorithm, at about 3 % of the positions instead of two thirds.
"""

from __future__ import annotations

import numpy as np

from lexloom.llm import kernel as K

WINDOW, GRAM = 100, 40
SPAN = WINDOW - GRAM + 1
SEGMENT = 1 << 24
_PLACE = np.uint64(SEGMENT - 1)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done, m = 1, x
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def sample(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of a run of documents (under ``SEGMENT`` bytes together): document index, position, hash of the
    anchor, first and last window start that name it, and the hash of all bytes of those windows with their layout."""
    n = len(data)
    if n < WINDOW:
        return {k: np.zeros(0, t) for k, t in (("doc", np.int64), ("pos", np.int64), ("fp", np.uint64), ("lo", np.int64), ("hi", np.int64), ("ctx", np.uint64))} | {"prefix": np.zeros(1, np.uint64)}
    prefix = K.prefix_hash(data, K.BYTES)
    h = K.mix((prefix[GRAM:] - prefix[:-GRAM]) * K.powers(n + 1)[1][: n - GRAM + 1])
    low = _least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), SPAN)
    at = (low & _PLACE).astype(np.int64)  # of window starts 0 .. n - WINDOW
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    whole = np.arange(len(at)) + WINDOW <= off[doc + 1]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return sample(data[:0], off[:1])
    pos, d = at[starts], doc[starts]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(pos) != 0) | (np.diff(d) != 0)]))
    lo = starts[first]
    hi = starts[np.append(first[1:], len(starts)) - 1]
    pos, d = pos[first], d[first]
    ctx = K.mix(K.span_hash(prefix, lo, hi + WINDOW) + (pos - lo).astype(np.uint64) * K.COEF[0] + (hi - lo).astype(np.uint64) * K.COEF[1])
    return {"doc": d, "pos": pos, "fp": h[pos], "lo": lo, "hi": hi, "ctx": ctx, "prefix": prefix}
