"""Word alignments with the kinds of their edits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Cells of a step's rows, over all pairs that are taken together.
CELLS = 1 << 16
_DELETION = 1 << 32


def _kinds_together(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Substitutions, deletions and insertions of pairs whose ``a`` come from the longest to the shortest.

    One row of all pairs' tables at a time; a pair is done after the rows of its ``a``. Steps to the right are a running minimum, and a cell reached by them takes its kinds from
    the nearest cell on its left that is not, so a row is a few whole-array steps and memory is a few rows. Columns beyond a pair's ``b`` are never read by those before them.
    """
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    x, y = np.full((la.max(initial=0), len(a)), -2, np.int32), np.full((len(b), lb.max(initial=0)), -2, np.int32)
    for k, (u, w) in enumerate(zip(a, b, strict=True)):
        x[: len(u), k], y[k, : len(w)] = u, w
    j = np.arange(y.shape[1] + 1, dtype=np.int32)
    cost, kinds = np.tile(j, (len(a), 1)), np.zeros((len(a), len(j)), np.int64)  # kinds: deletions above 32 bits of substitutions
    for i in range(1, len(x) + 1):
        m = int(np.searchsorted(-la, -i, side="right"))
        wrong = y[:m] != x[i - 1, :m, None]
        new = np.empty((m, len(j)), np.int32)
        new[:, 0] = i
        diagonal = cost[:m, :-1] + wrong
        down = cost[:m, 1:] + 1
        np.minimum(diagonal, down, out=new[:, 1:])
        new -= j
        np.minimum.accumulate(new, axis=1, out=new)
        new += j
        straight = new[:, 1:] == diagonal
        reached = np.zeros((m, len(j)), np.int32)
        reached[:, 1:] = np.where(straight | (new[:, 1:] == down), j[1:], 0)
        np.maximum.accumulate(reached, axis=1, out=reached)
        own = np.empty((m, len(j)), np.int64)
        own[:, 0] = i * _DELETION
        own[:, 1:] = np.where(straight, kinds[:m, :-1] + wrong, kinds[:m, 1:] + _DELETION)
        kinds[:m] = np.take_along_axis(own, reached, 1)
        cost[:m] = new
    at = np.arange(len(a))
    subs, dels = kinds[at, lb] % _DELETION, kinds[at, lb] // _DELETION
    return np.stack([subs, dels, cost[at, lb] - subs - dels], 1)


def edit_kinds_of(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """A row for each pair: substitutions, deletions and insertions that turn ``a`` into ``b``, with the least sum; where paths tie, the last step is a match or
    substitution first, then a deletion. Pairs of similar lengths are taken together, ``CELLS`` cells a step."""
    out = np.zeros((len(a), 3), np.int64)
    la, lb = np.array([len(x) for x in a], int), np.array([len(x) for x in b], int)
    order = np.lexsort((-la, -(lb // 16)))
    i = 0
    while i < len(order):
        part = order[i : i + max(1, CELLS // (int(lb[order[i]] // 16) * 16 + 16))]
        part = part[np.argsort(-la[part], kind="stable")]
        out[part] = _kinds_together([a[k] for k in part], [b[k] for k in part])
        i += len(part)
    return out


def edit_kinds(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """``edit_kinds_of`` for one pair."""
    return tuple(map(int, edit_kinds_of([a], [b])[0]))


KINDS = T.StructType([T.StructField(k, T.LongType()) for k in ("substitutions", "deletions", "insertions")])


@F.pandas_udf(KINDS)
def _kinds(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    known = (a.notna() & b.notna()).to_numpy()
    lists = [np.asarray(x, object) for side in (a, b) for x in side[known]]
    ids = np.split(pd.factorize(np.concatenate([np.zeros(0, object), *lists]))[0], np.cumsum([len(x) for x in lists])[:-1]) if lists else []
    rows = pd.DataFrame(pd.NA, index=range(len(a)), columns=KINDS.names, dtype="Int64")
    if lists:
        rows.loc[known] = edit_kinds_of(ids[: len(ids) // 2], ids[len(ids) // 2 :])
    return rows


def word_edits(a: Column, b: Column) -> Column:
    """substitutions, deletions and insertions from the words of ``a`` to those of ``b`` (arrays of string)."""
    return _kinds(a, b)
