"""Embedding analytics: centroids, similarity joins by pivots, nearest labels, outliers, components, average linkage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.expr import dot, unit
from lexloom.operators import graph
from lexloom.session import Tables, cut


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Unit mean of a label's unit vectors; sums by (label, position) aggregate before the shuffle."""
    parts = df.select(label, F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).withColumn("v", F.transform("v", lambda s: s["x"]))
    return mean.select(label, unit(F.col("v")).alias("centroid"))


#: Vectors of a cell at most, vectors of a bundle of cells, vectors for each pivot, pivots at most. They change what is compared and how it travels, never the result.
BLOCK_ROWS, BUNDLE_ROWS, FOR_PIVOT, PIVOTS = 4000, 16_000, 256, 256
#: Products that a task holds at a time.
STRIP = 1 << 20
#: Members of a component up to which one task clusters it, and links that one task takes over when so few are left of larger ones.
SMALL, LINKS = 1000, 200_000
#: Clusters of a block, and links of a pair of blocks that one task takes, where similarities of merged clusters are computed.
WIDE, HELD = 32_000, 1_000_000
#: Slack of angles, above the rounding of arccos near 0.
SLACK = 1e-6


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows with pivots."""
    length = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(pivots, axis=1)[None]
    return np.arccos(np.clip(np.divide(x @ pivots.T, length, out=np.zeros((len(x), len(pivots))), where=length > 0), -1, 1))


class _Groups:
    """Vectors by their nearest pivot: the pivots (a bounded sample by hash), and for each group its radius as an angle, least and greatest
    length, and its cells of at most about ``BLOCK_ROWS`` vectors. Cells that follow one another travel as a bundle. At most ``PIVOTS`` rows and one number a cell, whatever the input."""

    def __init__(self, df: DataFrame):
        kind = dict(df.dtypes)["id"]
        n = df.count()
        k = min(PIVOTS, max(1, -(-n // FOR_PIVOT)))
        self.pivots = np.array([r["v"] for r in df.orderBy(F.xxhash64("id"), "id").limit(k).collect()], float)
        pivots = self.pivots

        def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = _stack(f["v"])
                    a = _angles(x, pivots)
                    yield pd.DataFrame({"id": f["id"], "v": f["v"], "h": a.argmin(1), "near": a.min(1), "norm": np.linalg.norm(x, axis=1)})

        homes = cut(df.select("id", "v").mapInPandas(home, f"id {kind}, v array<double>, h int, near double, norm double")) if n else None
        found = homes.groupBy("h").agg(F.max("near").alias("r"), F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.count("*").alias("n")).collect() if n else []
        self.radius, self.lo, self.hi, rows = np.full(k, -np.inf), np.zeros(k), np.zeros(k), np.zeros(k, int)
        for r in found:
            self.radius[r["h"]], self.lo[r["h"]], self.hi[r["h"]], rows[r["h"]] = r["r"], r["lo"], r["hi"], r["n"]
        blocks = -(-rows // BLOCK_ROWS)
        self.group = np.repeat(np.arange(k), blocks)  # of each cell
        ahead = np.concatenate([[0], np.cumsum(np.repeat(rows / np.maximum(blocks, 1), blocks))])[:-1]
        self.bundle = np.unique(ahead // max(BLOCK_ROWS, min(BUNDLE_ROWS, -(-n // 12))), return_inverse=True)[1]  # of each cell, ascending
        self.homes = homes
        if n:
            of = lambda values, at: F.element_at(F.array(*(F.lit(int(x)) for x in values)), at + 1)
            many, first = of(blocks, F.col("h")), of(np.cumsum(blocks) - blocks, F.col("h"))
            cell = first + F.when(many > 1, F.pmod(F.xxhash64("id"), many)).otherwise(0).cast("int")
            self.homes = homes.select("id", "v", cell.alias("cell")).withColumn("part", of(self.bundle, F.col("cell")))


def _meets(f: pd.DataFrame, near, group: np.ndarray, own: bool) -> np.ndarray:
    """Rows by cells: whether a row has to meet a cell. ``near(v)`` says which groups may hold partners; ``own``: a row meets its own cell and later ones, so that two rows meet once."""
    meets = near(_stack(f["v"]))[:, group]
    return meets & (np.arange(len(group))[None] >= f["cell"].to_numpy()[:, None]) if own else meets


def _together(rows: DataFrame, groups: _Groups, near, own: bool) -> DataFrame:
    """id, v, cell, home by (part, to): the rows of a part (id, v, cell, part) that have to meet a bundle, and the bundle. Python names the bundles of a row,
    Spark copies it: no Arrow batch grows with the number of bundles, and a row travels once for each bundle, not for each cell."""
    kind, group, starts = dict(rows.dtypes)["id"], groups.group, np.flatnonzero(np.diff(groups.bundle, prepend=-1))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                to = np.logical_or.reduceat(_meets(f, near, group, own), starts, axis=1)
                yield f.assign(to=np.split(np.nonzero(to)[1], np.cumsum(to.sum(1))[:-1]))

    dealt = cut(rows.select("id", "v", "cell", "part").mapInPandas(deal, f"id {kind}, v array<double>, cell int, part int, to array<int>"))
    asked = dealt.select("part", F.explode("to").alias("to")).distinct().groupBy("to").agg(F.collect_list("part").alias("parts"))  # one row a bundle
    visits = dealt.select("id", "v", "cell", "part", F.explode("to").alias("to"), F.lit(False).alias("home"))
    at_home = groups.homes.withColumnRenamed("part", "to").join(F.broadcast(asked), "to").select("id", "v", "cell", F.explode("parts").alias("part"), "to", F.lit(True).alias("home"))
    return visits.unionByName(at_home)


def _sides(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """id, cell and vectors of the visitors and of those at home, in the order of cells and ids."""
    held = [(f["home"].to_numpy(bool), f["id"].to_numpy(), f["cell"].to_numpy(), _stack(f["v"])) for f in frames if len(f)]
    home, uid, cell, x = map(np.concatenate, zip(*held, strict=True))
    for side in (~home, home):
        at = np.flatnonzero(side)
        at = at[np.argsort(uid[at], kind="stable")]
        at = at[np.argsort(cell[at], kind="stable")]
        yield uid[at], cell[at], x[at]


def _products(x: np.ndarray, cell: np.ndarray | None, y: np.ndarray, at_home: np.ndarray, near, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, slice, np.ndarray]]:
    """cell, rows of ``x``, its slice of ``y`` and their dot products, ``STRIP`` at a time, for every cell at home and the rows that have to meet it."""
    meets = np.concatenate([near(x[i : i + BLOCK_ROWS]) for i in range(0, len(x), BLOCK_ROWS)]) if len(x) and len(y) else np.zeros((0, 0), bool)
    for k in np.unique(at_home) if len(meets) else ():
        right = slice(*np.searchsorted(at_home, [k, k + 1]))
        rows = np.flatnonzero(meets[:, group[k]] & (True if cell is None else cell <= k))
        step = max(1, STRIP // (right.stop - right.start))
        for i in range(0, len(rows), step):
            yield k, rows[i : i + step], right, x[rows[i : i + step]] @ y[right].T


def _by_angle(groups: _Groups, threshold: float):
    """Which groups may hold a vector whose cosine reaches the threshold."""
    pivots, reach = groups.pivots, np.arccos(np.clip(threshold, -1, 1)) + groups.radius + SLACK
    return lambda x: _angles(x, pivots) <= reach[None]


def meetings(df: DataFrame, uid: str, vector: str, threshold: float) -> int:
    """How many pairs of cells ``similar_pairs`` compares."""
    groups = _Groups(df.select(F.col(uid).alias("id"), unit(F.col(vector)).alias("v")))
    near, group = _by_angle(groups, threshold), groups.group

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                i, k = np.nonzero(_meets(f, near, group, True))
                yield pd.DataFrame({"cell": f["cell"].to_numpy()[i], "k": k}).drop_duplicates()

    return groups.homes.mapInPandas(pairs, "cell int, k int").distinct().count()


def similar_pairs(df: DataFrame, uid: str, vector: str, threshold: float) -> DataFrame:
    """a, b, cosine of all pairs with cosine >= threshold; equal vectors are one class, paired by its least id, with a row for each other member.

    Vectors belong to their nearest pivot. By the triangle inequality on angles a vector can have partners only in groups whose pivot is no
    further away than the threshold's angle and the group's radius together, so it is sent to bundles that hold such groups, and there
    meets these groups alone, strip by strip inside numpy. The pruning is exact; it saves most where vectors have clusters and the threshold
    is high, and in spread-out vectors of many dimensions little.
    """
    rows = cut(df.select(F.col(uid).alias("id"), unit(F.col(vector)).alias("v")))
    classes = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "v", "n"))
    kind = dict(rows.dtypes)["id"]
    copies = rows.join(classes.filter("n > 1").select(F.col("id").alias("a"), "v"), "v").filter("id != a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    if threshold > 1 or classes.isEmpty():
        return copies.filter(F.lit(threshold <= 1))
    groups = _Groups(classes.select("id", "v"))
    near, group = _by_angle(groups, threshold), groups.group

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (a, cell, x), (b, at_home, y) = _sides(frames)
        for k, left, right, s in _products(x, cell, y, at_home, near, group):
            i, j = np.nonzero(s >= threshold)
            u, w = a[left[i]], b[right][j]
            keep = (cell[left[i]] < k) | (u < w)
            yield pd.DataFrame({"a": np.minimum(u, w)[keep], "b": np.maximum(u, w)[keep], "cosine": s[i, j][keep]})

    return _together(groups.homes, groups, near, True).groupBy("part", "to").applyInPandas(meet, f"a {kind}, b {kind}, cosine double").unionByName(copies)


def nearest(left: DataFrame, right: DataFrame, label: str, vector: str) -> DataFrame:
    """label, nearest, cosine: the greatest dot product with a row of ``right``, the least label on ties.

    The best dot product with a pivot, which is a row of ``right``, is what others have to reach; a group is met only where its angle,
    radius and lengths allow that.
    """
    kind = dict(left.dtypes)[label]
    a, b = (cut(side.select(F.col(label).alias("id"), F.col(vector).cast("array<double>").alias("v"))) for side in (left, right))
    groups = _Groups(b)
    if groups.homes is None or a.isEmpty():
        return a.select(F.col("id").alias(label), F.col("id").alias("nearest"), F.lit(0.0).alias("cosine")).limit(0)
    pivots, radius, lo, hi, group = groups.pivots, groups.radius, groups.lo, groups.hi, groups.group

    def near(x: np.ndarray) -> np.ndarray:
        most = np.cos(np.maximum(_angles(x, pivots) - radius[None] - SLACK, 0))
        bound = np.linalg.norm(x, axis=1)[:, None] * np.where(most >= 0, hi[None] * most, lo[None] * most)
        best = (x @ pivots.T).max(1)
        return bound + SLACK * np.maximum(1, np.abs(best))[:, None] >= best[:, None]

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (uid, _, x), (other, at_home, y) = _sides(frames)
        best, who = np.full(len(uid), -np.inf), np.zeros(len(uid), other.dtype)
        for _, rows, held, s in _products(x, None, y, at_home, near, group):
            at = s.argmax(1)  # the least id of a cell on ties
            most, found = s[np.arange(len(s)), at], other[held][at]
            better = (most > best[rows]) | ((most == best[rows]) & (found < who[rows]))
            best[rows[better]], who[rows[better]] = most[better], found[better]
        met = best > -np.inf
        yield pd.DataFrame({"id": uid[met], "nearest": who[met], "cosine": best[met]})

    parts = max(1, -(-a.count() // BUNDLE_ROWS))
    asked = a.select("id", "v", F.lit(0).alias("cell"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    best = _together(asked, groups, near, False).groupBy("part", "to").applyInPandas(meet, f"id {kind}, nearest {kind}, cosine double")
    return best.groupBy(F.col("id").alias(label)).agg(F.max_by("nearest", F.struct("cosine", -F.col("nearest"))).alias("nearest"), F.max("cosine").alias("cosine"))


def leave_one_out(df: DataFrame, uid: str, label: str, vector: str) -> DataFrame:
    """Cosine of each vector with the mean of its label's others; NULL where there is none."""
    rows = df.select(uid, label, unit(F.col(vector)).alias("v"))
    sums = rows.select(label, F.posexplode("v").alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    total = sums.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))
    rest = F.zip_with("total", "v", lambda t, x: t - x)
    both = rows.join(total, label).withColumn("rest", rest)
    return both.select(uid, label, F.when(F.col("n") > 1, dot(F.col("rest"), F.col("v")) / F.sqrt(dot(F.col("rest"), F.col("rest")))).alias("cosine"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component (least node reachable) of every node; edges are columns a, b."""
    found = graph.components(edges.select("a", "b"))
    every = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("component"))


def average_linkage(sim: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster number of each row: the pair of clusters with the greatest mean similarity merges while it reaches the threshold."""
    n = len(sim)
    mean, size, alive = sim.astype(float).copy(), np.ones(n), np.ones(n, bool)
    np.fill_diagonal(mean, -np.inf)
    owner = np.arange(n)
    while alive.sum() > 1:
        i, j = divmod(int(np.argmax(mean)), n)
        if mean[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (mean[i] * size[i] + mean[j] * size[j]) / (size[i] + size[j])
        row[[i, j]] = -np.inf
        row[~alive] = -np.inf
        mean[i], mean[:, i] = row, row
        mean[j], mean[:, j] = -np.inf, -np.inf
        size[i] += size[j]
        alive[j] = False
        owner[owner == j] = i
    return owner


def _merged_in_rounds(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """node, cluster of ``rows`` (id, v): average linkage over ``pairs`` (a, b, cosine, as ``similar_pairs`` gives them), in rounds over all clusters.

    In each round every two clusters that are each other's most similar one merge. A merged cluster is never more similar to a third than both of its
    halves were, so no later merge undoes such a choice and the clusters are those of merging one pair after the other; and for the same
    reason two clusters below the threshold never matter again, so that pairs only become fewer. A mean similarity is the product of two sums of vectors.

    What a round leaves is written as tables. A checkpoint would hand on Spark's estimate of its size, a product over all joins of all rounds
    whose digits, kept and multiplied on the driver, become about six times as many in each round; a table has the size of its files.
    """
    tables, k = Tables(rows.sparkSession), 0
    classes = rows.groupBy("v").agg(F.min("id").alias("c"), F.count("*").alias("n"))  # equal vectors merge first
    classes = tables.write("classes", classes.select("c", F.col("v").alias("own"), F.transform("v", lambda x: x * F.col("n")).alias("s"), "n"))
    member = tables.write("member", rows.join(classes.select("c", F.col("own").alias("v")), "v").select(F.col("id").alias("node"), F.col("c").alias("cluster")))
    sums = classes.select("c", "s", "n")
    edges = tables.write("edges", pairs.join(classes.select(F.col("c").alias("a")), "a", "left_semi").join(classes.select(F.col("c").alias("b")), "b", "left_semi").select("a", "b", F.col("cosine").alias("mean")))
    held = ["classes", "member", "edges"]
    while edges.count() > LINKS:
        k, old = k + 1, held
        held = [f"{name}{k}" for name in ("sums", "member", "moved", "fresh")]
        rank = F.struct("mean", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
        best = edges.select(F.explode(F.array("a", "b")).alias("c"), rank.alias("rank")).groupBy("c").agg(F.max("rank").alias("rank"))
        merges = best.groupBy((-F.col("rank.a")).alias("into"), (-F.col("rank.b")).alias("gone")).agg(F.count("*").alias("k")).filter("k = 2").select("into", "gone")
        merges = tables.write(f"merges{k}", merges)
        gone = merges.select(F.col("gone").alias("c"), "into")
        added = sums.join(gone, "c").select(F.col("into").alias("c"), F.col("s").alias("t"), F.col("n").alias("m"))
        rest = sums.join(gone, "c", "left_anti").join(added, "c", "left")
        rest = rest.select("c", F.when(F.col("m").isNull(), F.col("s")).otherwise(F.zip_with("s", "t", lambda x, y: x + y)).alias("s"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        sums = tables.write(held[0], rest)
        member = tables.write(held[1], member.join(gone, member.cluster == gone.c, "left").select("node", F.coalesce("into", "cluster").alias("cluster")))
        now = merges.select(F.explode(F.array("into", "gone")).alias("old"), F.col("into").alias("new"))
        for end in ("a", "b"):
            edges = edges.join(now.select(F.col("old").alias(end), F.col("new").alias(f"{end}_new")), end, "left")
        a, b = F.coalesce("a_new", "a"), F.coalesce("b_new", "b")
        mean = F.when(F.col("a_new").isNull() & F.col("b_new").isNull(), F.col("mean"))  # unknown where an end has changed
        moved = tables.write(held[2], edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), mean.alias("mean")).filter("a != b"))
        fresh = tables.write(held[3], _means(moved.filter("mean is null").select("a", "b"), sums, threshold))
        edges = moved.filter("mean is not null").unionByName(fresh)
        tables.drop(*old, f"merges{k}")
    ends = edges.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    kind = dict(rows.dtypes)["id"]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        links, clusters = pdf[pdf["mean"].notna()], pdf[pdf["mean"].isna()].sort_values("a")
        ids = clusters["a"].to_numpy()
        a, b = (np.searchsorted(ids, links[e].to_numpy()) for e in ("a", "b"))
        return pd.DataFrame({"c": ids, "into": ids[_merge_links(a, b, links["mean"].to_numpy(), _stack(clusters["s"]), clusters["n"].to_numpy(float, copy=True), threshold)]})

    no = F.lit(None)
    rest = edges.select("a", "b", "mean", no.cast("array<double>").alias("s"), no.cast("long").alias("n")).unionByName(
        sums.join(ends, "c", "left_semi").select(F.col("c").alias("a"), F.col("c").alias("b"), no.cast("double").alias("mean"), "s", "n")
    )
    into = rest.groupBy().applyInPandas(finish, f"c {kind}, into {kind}")  # LINKS rows at most, and their ends
    out = cut(member.join(into, member.cluster == into.c, "left").select("node", F.coalesce("into", "cluster").alias("cluster")))
    tables.drop()
    return out


def _means(links: DataFrame, sums: DataFrame, threshold: float) -> DataFrame:
    """a, b, mean of links (a, b, in which repeats are one) whose mean similarity reaches the threshold; ``sums``: c, s, n of every cluster.

    A sum travels once for each pair of blocks of clusters, not for each link.
    """
    kind = dict(links.dtypes)["a"]
    ends = sums.join(links.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi")
    many = -(-ends.count() // WIDE)
    strips = -(-2 * links.count() // (HELD * max(1, many * (many + 1))))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, many))).cast("int")
    strip = F.pmod(F.xxhash64("a", "b"), F.lit(max(1, strips))).cast("int")
    at = lambda p, q, strip: (F.least(p, q).alias("x"), F.greatest(p, q).alias("y"), strip.alias("z"))
    met = ends.withColumn("p", block("c")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max(0, many - 1))))).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(max(0, strips - 1)))))

    def mean(links: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("c")
        ids, n = ends["c"].to_numpy(), ends["n"].to_numpy(float)
        if not len(links):
            return pd.DataFrame({"a": ids[:0], "b": ids[:0], "mean": n[:0]})
        i, j = np.divmod(np.unique(np.searchsorted(ids, links["a"].to_numpy()) * len(ids) + np.searchsorted(ids, links["b"].to_numpy())), len(ids))
        found = _linked(i, j, _stack(ends["s"]), n)
        keep = found >= threshold
        return pd.DataFrame({"a": ids[i[keep]], "b": ids[j[keep]], "mean": found[keep]})

    left = links.select(*at(block("a"), block("b"), strip), "a", "b").groupBy("x", "y", "z")
    return left.cogroup(met.select(*at(F.col("p"), F.col("q"), F.col("z")), "c", "s", "n").groupBy("x", "y", "z")).applyInPandas(mean, f"a {kind}, b {kind}, mean double")


def _linked(i: np.ndarray, j: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean similarities of clusters ``i`` and ``j``, by their sums ``s`` and sizes ``n``."""
    step = 20_000
    parts = ((i[k : k + step], j[k : k + step]) for k in range(0, len(i), step))
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", s[a], s[b]) / (n[a] * n[b]) for a, b in parts)])


def _merge_links(a: np.ndarray, b: np.ndarray, mean: np.ndarray, s: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """The rounds of ``_merged_in_rounds`` over links that are all at hand (a < b, places in ``s`` and ``n``): each place's cluster."""
    owner = np.arange(len(n))
    while len(a):
        order = np.lexsort((b, a, -mean))
        best = np.full(len(n), len(a))
        for end in (a, b):
            np.minimum.at(best, end[order], np.arange(len(a)))
        both = order[np.flatnonzero((best[a[order]] == np.arange(len(a))) & (best[b[order]] == np.arange(len(a))))]
        into, gone = a[both], b[both]
        s[into] += s[gone]
        n[into] += n[gone]
        new, touched = np.arange(len(n)), np.zeros(len(n), bool)
        new[gone], touched[into] = into, True
        owner = new[owner]
        a, b = new[a], new[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        old = ~touched[a] & ~touched[b]
        pair = np.unique(np.stack([a, b], 1)[~old & (a != b)], axis=0)
        fresh = _linked(pair[:, 0], pair[:, 1], s, n)
        keep = fresh >= threshold
        a, b, mean = np.concatenate([a[old], pair[keep, 0]]), np.concatenate([b[old], pair[keep, 1]]), np.concatenate([mean[old], fresh[keep]])
    return owner


def average_clusters(df: DataFrame, uid: str, vector: str, threshold: float) -> DataFrame:
    """node, cluster (its least node) by average linkage of cosines. Vectors of two components of the similarity graph never share a cluster:
    a component of up to ``SMALL`` members is clustered by one task, larger ones in rounds."""
    rows = cut(df.select(F.col(uid).alias("id"), unit(F.col(vector)).alias("v")))
    tables = Tables(df.sparkSession)
    pairs = tables.write("pairs", similar_pairs(df, uid, vector, threshold))
    comps = cut(components(pairs, rows.select("id")))
    large = cut(comps.groupBy("component").count().filter(F.col("count") > SMALL).select("component"))
    kind = dict(rows.dtypes)["id"]

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = _stack(pdf["v"])
        return pd.DataFrame({"node": pdf["node"], "cluster": pdf["node"].to_numpy()[average_linkage(x @ x.T, threshold)]})

    few = comps.join(large, "component", "left_anti").join(rows, F.col("node") == F.col("id")).select("node", "component", "v")
    out = few.groupBy("component").applyInPandas(cluster, f"node {kind}, cluster {kind}")
    if not large.isEmpty():
        many = comps.join(large, "component", "left_semi").select("node")
        mine = pairs.join(many.withColumnRenamed("node", "a"), "a", "left_semi")
        out = out.unionByName(_merged_in_rounds(mine, rows.join(many, F.col("node") == F.col("id"), "left_semi"), threshold))
    tables.drop()
    return out


def partial_moments(df: DataFrame, vector: str) -> DataFrame:
    """i, j (i <= j), product, total (of i), n: each partition's sums over its vectors; vectors of one length are taken together."""

    def add(frames):
        held: dict[int, tuple] = {}
        for frame in frames:
            by = frame[vector].dropna()
            for size, part in by.groupby(by.map(len)):
                x = np.stack(part.to_list()).astype(float)
                product, total, n = held.get(size, (0.0, 0.0, 0))
                held[size] = (product + x.T @ x, total + x.sum(0), n + len(x))
        for size, (product, total, n) in held.items():
            i, j = np.triu_indices(size)
            yield pd.DataFrame({"i": i, "j": j, "product": product[i, j], "total": total[i], "n": n}) if size else pd.DataFrame(columns=["i", "j", "product", "total", "n"])

    return df.select(vector).mapInPandas(add, "i int, j int, product double, total double, n long")
