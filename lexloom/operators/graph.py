"""Connected components: every partition first replaces its edges by stars of its own components, then alternating large-star and
small-star steps join them, to convergence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

ROWS = 50_000
#: Edges that a task holds at most.
HELD = 20 * ROWS


def fit(df: DataFrame) -> tuple[DataFrame, int]:
    """``df``, written to the shared folder and held in partitions of about ROWS rows, and its number of rows. A table of up to
    ROWS rows is one partition, on which Spark joins and sums without exchanges; a larger one keeps as many as it has rows for."""
    done = cut(df)
    n = done.count()
    return done.coalesce(max(1, -(-n // ROWS))), n


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its larger (or its smaller) neighbours to its least neighbour; minima are taken before rows meet."""
    if large:
        near = edges.union(edges.select("v", "u")).toDF("u", "v")
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    rows = near.join(least, "u")
    if large:
        return rows.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    return rows.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that least node, for edges that are all at hand."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    apart = np.flatnonzero(label != np.arange(len(ids)))
    return ids[apart], ids[label[apart]]


def _local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of a partition's edges. A partition above ``HELD`` rows is folded as it comes: stars stand for the edges so far, and are handed on where they don't become fewer."""
    held, n = [], 0
    for f in frames:
        if len(f):
            held, n = [*held, f], n + len(f)
        if n > HELD:
            stars = _stars(held)
            held, n = [stars], len(stars)
            if n > HELD // 2:
                yield stars
                held, n = [], 0
    if n:
        yield _stars(held)


def _stars(held: list[pd.DataFrame]) -> pd.DataFrame:
    u, v = local_stars(*(np.concatenate([f[c].to_numpy() for f in held]) for c in ("u", "v")))
    return pd.DataFrame({"u": u, "v": v})


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) for each node of ``edges`` (two columns of comparable ids)."""
    now, n = fit(edges.toDF("u", "v").filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = cut(now.mapInPandas(_local, now.schema))
    if n > ROWS:  # more than one partition
        mark = None
        while True:
            now = cut(_star(_star(now, True), False))
            row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            now = now.coalesce(max(1, -(-row["n"] // ROWS)))
            if row == mark:
                break
            mark = row
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(nodes.select(F.col("comp").alias("node"), "comp").distinct())
