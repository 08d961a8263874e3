"""Centroid clustering of integer vectors, by filtering kd-trees.

Vectors are put into kd-trees once: a task cuts its rows into blocks of ``ROWS``, and a block is a balanced
tree whose nodes hold a count, integer sums and a box (least and greatest value of each component). Trees are
written to the shared folder, one row a block, and every round reads them. A round walks down a block's tree,
all nodes of a level in one numpy step: the candidate nearest to a node's middle dominates another strictly
if it is nearer at the corner of the box that is best for the other; such candidates are pruned for the node
and all below it. A node with one candidate left is assigned whole, by its count and sums; at the leaves the
rest is resolved exactly, vector by vector. Only strictly dominated candidates go, so ties are met at the leaves,
where the smaller number wins. All arithmetic is on whole numbers: results do not depend on partitions.

A round sends one row of sums for each block and centroid that has members, adds them up in the JVM, and the driver sees
``k`` rows of counts and sums: nothing there grows with the input.

Edge cases: vectors that are null, of another length, or with a null, NaN or infinite component are left out; a
null id is a vector as any other, and a start only where ids run out; repeated rows count each; fewer vectors than ``k`` give as many
centroids; an empty table gives an empty result. Components beyond 2**27 are an error, as their squared distances do not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import Tables, cut

#: Vectors of a block, of a leaf at most.
ROWS, LEAF = 4096, 16
LIMIT = 1 << 27


def quantised(df: DataFrame, id_: str, vector: str, size: int, scale: float) -> DataFrame:
    """id and v (array of long): floor(scale * component) of the vectors that have ``size`` finite components."""
    x = F.col(vector).cast("array<double>")
    whole = (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    value = F.transform(x, lambda e: F.when(F.abs(e * scale) > LIMIT, F.raise_error(F.lit("a component is too large for whole-number distances")).cast("long")).otherwise(F.floor(e * scale)))
    return df.filter(F.col(vector).isNotNull()).filter(whole).select(F.col(id_).cast("long").alias("id"), value.alias("v"))


def starts(points: DataFrame, k: int, seed: str = "1") -> np.ndarray:
    """The ``k`` vectors whose ids' SHA-256 (of "seed:id") come first, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = points.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def levels(n: int) -> int:
    """Levels below the root of a tree over n vectors."""
    return max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))


def bounds(n: int, depth: int) -> np.ndarray:
    """First places of the nodes of one level, and n: each node is halved, so the shape follows from n alone."""
    at = np.array([0, n])
    for _ in range(depth):
        mid = (at[:-1] + at[1:]) // 2
        at = np.append(np.stack([at[:-1], mid], 1).ravel(), n)
    return at


def build(x: np.ndarray) -> np.ndarray:
    """Order of the rows in a balanced kd-tree: every node is halved at the median of its widest component."""
    order = np.arange(len(x))
    for depth in range(levels(len(x))):
        at = bounds(len(x), depth)
        for a, b in zip(at[:-1], at[1:], strict=True):
            part = x[order[a:b]]
            axis = int((part.max(0) - part.min(0)).argmax())
            order[a:b] = order[a:b][np.argpartition(part[:, axis], (b - a) // 2 - (1 if b - a == 1 else 0))]
    return order


def summary(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, least and greatest values of all nodes, the root first, level by level; ``x`` is in tree order."""
    at = bounds(len(x), levels(len(x)))[:-1]
    rows = [(np.add.reduceat(x, at), np.minimum.reduceat(x, at), np.maximum.reduceat(x, at))]
    while len(rows[0][0]) > 1:
        s, lo, hi = rows[0]
        rows.insert(0, (s[::2] + s[1::2], np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))
    return tuple(np.concatenate(part) for part in zip(*rows, strict=True))


def survivors(lo: np.ndarray, hi: np.ndarray, c: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Which candidates (nodes x centroids) are left when the one nearest to each box's middle has pruned those it strictly dominates."""
    middle = lo + hi  # twice the middle, a whole number
    far = ((middle[:, None, :] - 2 * c[None]) ** 2).sum(2)
    best = np.where(open_, far, np.iinfo(np.int64).max).argmin(1)
    star = c[best][:, None, :]
    corner = np.where(c[None] > star, hi[:, None, :], lo[:, None, :])  # of the box, the best one for the candidate against the star
    worse = ((corner - c[None]) ** 2).sum(2) > ((corner - star) ** 2).sum(2)
    return open_ & ~worse


def walk(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """The cluster of each vector of a block, and what its nodes and leaves add to clusters, as (cluster, count, sums)."""
    sums, lo, hi = tree
    owner, parts = np.full(len(x), -1), []
    open_, first = np.ones((1, len(c)), bool), 0
    for depth in range(levels(len(x)) + 1):
        m, at = 1 << depth, bounds(len(x), depth)
        here = np.flatnonzero(open_.any(1))
        left = np.zeros_like(open_)
        left[here] = survivors(lo[first + here], hi[first + here], c, open_[here])
        done = np.flatnonzero(left.sum(1) == 1)
        for node in done:  # whole nodes
            z = int(left[node].argmax())
            owner[at[node] : at[node + 1]] = z
            parts.append((z, int(at[node + 1] - at[node]), sums[first + node]))
        left[done] = False
        if depth == levels(len(x)):
            for node in np.flatnonzero(left.any(1)):  # leaves
                a, b, some = at[node], at[node + 1], np.flatnonzero(left[node])
                near = some[((x[a:b, None, :] - c[some][None]) ** 2).sum(2).argmin(1)]
                owner[a:b] = near
                parts += [(int(z), int((near == z).sum()), x[a:b][near == z].sum(0)) for z in np.unique(near)]
        first, open_ = first + m, np.repeat(left, 2, axis=0)
    return owner, parts


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of id and v to blocks: ids, vectors in tree order, and the nodes."""
    ids, rows, held = [], [], 0

    def block(i: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        order = build(x)
        x = x[order]
        blobs = [pa.array([p.astype("<i8").tobytes()], pa.binary()) for p in (x, *summary(x))]
        return pa.RecordBatch.from_arrays([pa.array([i.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), *blobs], ["ids", "x", "sums", "lo", "hi"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column(0))
        rows.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        held += batch.num_rows
        while held >= ROWS:
            i, x = pa.concat_arrays(ids), np.concatenate(rows)
            yield block(i[:ROWS], x[:ROWS])
            ids, rows, held = [i[ROWS:]], [x[ROWS:]], held - ROWS
    if held:
        yield block(pa.concat_arrays(ids), np.concatenate(rows))


def plant(points: DataFrame) -> DataFrame:
    return points.mapInArrow(_plant, "ids array<long>, x binary, sums binary, lo binary, hi binary")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int):
    for batch in batches:
        for row in range(batch.num_rows):
            x, *tree = (np.frombuffer(batch.column(i)[row].as_py(), "<i8").reshape(-1, dims) for i in range(1, 5))
            yield batch.column(0)[row].values, x, tuple(tree)


def _sums(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, tree in _blocks(batches, c.shape[1]):
            _, parts = walk(x, tree, c)
            of = sorted({z for z, _, _ in parts})
            total = [sum(s for z, _, s in parts if z == w) for w in of]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([sum(n for z, n, _ in parts if z == w) for w in of], pa.int64()), pa.array([t.tolist() for t in total], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _members(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, tree in _blocks(batches, c.shape[1]):
            owner, _ = walk(x, tree, c)
            yield pa.RecordBatch.from_arrays([ids, pa.array(owner, pa.int32()), pa.array(((x - c[owner]) ** 2).sum(1), pa.int64())], ["id", "cluster", "distance"])

    return run


def moved(trees: DataFrame, c: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays."""
    parts = trees.mapInArrow(_sums(c), "cluster int, n long, sums array<long>")
    n = parts.select("cluster", F.col("n"), F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = c.copy()
    for r in n.collect():  # k rows for each component
        out[r["cluster"], r["i"]] = r["s"] // r["n"]
    return out


def cluster(points: DataFrame, k: int, rounds: int, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance (squared) of every vector, and the final centroids. ``points`` has id and v, as ``quantised`` makes them."""
    tables = Tables(points.sparkSession)
    points = tables.write("points", points)
    c = starts(points, k, seed)
    if not len(c):
        return points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), c
    trees = tables.write("trees", plant(points))
    for _ in range(rounds):
        c = moved(trees, c)
    out = cut(trees.mapInArrow(_members(c), "id long, cluster int, distance long"))
    tables.drop()
    return out, c


def report(members: DataFrame, c: np.ndarray) -> DataFrame:
    """``members`` with each cluster's and the whole inertia and the centroid's SHA-256 (of its components, joined by commas)."""
    sums = {r["cluster"]: int(r["s"]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows

    def each(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("cluster") + 1).cast(kind)

    if not sums:
        return members.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    marks = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    inertia = F.lit(sum(sums.values())).cast("long").alias("inertia")
    return members.select("*", each([sums.get(i, 0) for i in range(len(c))], "long").alias("cluster_inertia"), inertia, each(marks, "string").alias("centroid_sha256"))
