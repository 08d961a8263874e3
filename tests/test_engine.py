"""Operators against plain versions: dedup by two keys, prepare and merge, manifests, comparisons, splits, cases, arrays, hooks, streams."""

import glob
import hashlib
import json
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom.functions import arrays as A
from lexloom.functions import duration, hooks, specs
from lexloom.operators import compare as C
from lexloom.operators import curate, graph
from lexloom.operators import intervals as I
from lexloom.operators import prepare as P
from lexloom.operators import ranges as I_ranges
from lexloom.operators import splits as S
from lexloom.operators import vectors as V
from lexloom.operators.cases import greedy_cases
from lexloom.plans import catalogue
from lexloom.session import folder
from lexloom.streaming import shards

SF = "/root/testdata/sf0.001"


def first_of_two(rows):
    x, y, out = set(), set(), {}
    for o, a, b in sorted(rows):
        out[o] = (a is not None and a in x) or (b is not None and b in y)
        if not out[o]:
            x.add(a)
            y.add(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_first_of_two_keys(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.randrange(60), r.randrange(60)) for i in range(150)]
    got = P.first_of_two(spark.createDataFrame(rows, "o long, a long, b long"), "a", "b", "o").collect()
    assert {x["o"]: x["duplicate"] for x in got} == first_of_two(rows)


@pytest.mark.parametrize("bound", [1, 1 << 20])
def test_first_of_two_keys_with_nulls_chains_and_hot_keys(spark, monkeypatch, bound):
    """Null keys are like no other; a chain is settled in order inside its component, or in rounds where that is too large."""
    monkeypatch.setattr(P, "PASS_ROWS", bound)
    r = random.Random(8)
    rows = [(i, r.choice([None, r.randrange(40)]), r.choice([None, r.randrange(40)])) for i in range(120)]
    rows += [(1000 + i, 1000 + i // 2, 1000 + (i + 1) // 2) for i in range(12 if bound == 1 else 1500)]  # each shares a key with the one before
    rows += [(5000 + i, 77777, 5000 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "o long, a long, b long")
    assert {x["o"]: x["duplicate"] for x in P.first_of_two(df, "a", "b", "o").collect()} == first_of_two(rows)
    assert P.first_of_two(df.limit(0), "a", "b", "o").count() == 0


def test_first_of_two_keys_by_an_order_that_is_no_number(spark):
    rows = [(f"{i:03}", r, s) for i, (r, s) in enumerate([(1, 1), (1, 2), (2, 2), (3, 1), (4, None), (None, None)])]
    got = P.first_of_two(spark.createDataFrame(rows, "o string, a long, b long"), "a", "b", "o").collect()
    assert {x["o"]: x["duplicate"] for x in got} == first_of_two(rows)


def test_two_key_query(spark):
    docs = [(r["doc_id"], r["doc_id"] // 2, r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {x["doc_id"]: x["duplicate"] for x in catalogue.queries()["two_key_dedup"](spark, SF).collect()} == first_of_two(docs)


def partition(spark, k, out, **more):
    rows = [(k * 100 + i, f"u{k * 100 + i}", f"d{(k * 100 + i) // 2}", f"s{i % 3}", "train" if i % 3 < 2 else "test", [float(i), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "arrival long, uid string, digest string, speaker string, split string, z array<double>").withColumn("text", F.lit("t"))
    error = P.messages((F.col("arrival") % 10 == 5, "Silent audio"))
    return P.prepare_partition(df, out, error, {"seed": 1, "partition": k, "partitions": 2, "source": "x", **more}, "z")


def test_prepare_and_merge(spark, tmp_path):
    metas = [partition(spark, k, f"{tmp_path}/p{k}") for k in range(2)]
    assert metas[0] == P.read_json(spark, f"{tmp_path}/p0/metadata.json") and metas[0]["complete"] and metas[0]["accepted"] + metas[0]["rejected"] == 12
    reasons = {r["uid"]: r["error"] for r in spark.read.json(f"{tmp_path}/p0/rejected").collect()}
    assert reasons["u5"] == "Silent audio" and reasons["u1"] == "Duplicate audio or ID" and "u4" not in reasons
    kept = spark.read.parquet(f"{tmp_path}/p0/samples").filter("split = 'train'").collect()
    stats = {r["channel"]: (r["n"], r["s"], r["q"]) for r in spark.read.parquet(f"{tmp_path}/p0/stats").collect()}
    assert stats[0] == (len(kept), sum(r["z"][0] for r in kept), sum(r["z"][0] ** 2 for r in kept))
    with pytest.raises(ValueError, match="already"):
        partition(spark, 0, f"{tmp_path}/p0")
    P.check_partitions(metas, ["seed"])
    for broken in (metas[:1], [metas[0], metas[1] | {"seed": 2}], [metas[0], metas[1] | {"complete": False}]):
        with pytest.raises(ValueError):
            P.check_partitions(broken, ["seed"])
    with pytest.raises(ValueError, match="empty"):
        P.not_empty(spark.range(0), "x")
    both = spark.read.parquet(f"{tmp_path}/p0/samples", f"{tmp_path}/p1/samples")
    merged, gone = P.merged(both, drop_uids=spark.createDataFrame([("u0",)], "uid string"))
    assert gone == {"duplicates": 0, "conflicts": 0, "dropped": 1, "singletons": 0, "samples": both.count() - 1, "reassigned": 0} == gone | {"samples": merged.count()}
    twice = both.unionByName(both.withColumn("uid", F.concat("uid", F.lit("x"))).withColumn("arrival", F.col("arrival") + 1000))
    assert P.merged(twice)[1]["duplicates"] == both.count()
    first = both.first()
    with pytest.raises(ValueError, match="collision"):
        P.merged(both.unionByName(both.limit(1).withColumn("digest", F.lit("other")).withColumn("arrival", F.lit(9999))))
    other = both.filter(F.col("uid") == first["uid"]).withColumn("uid", F.lit("n")).withColumn("text", F.lit("other")).withColumn("arrival", F.lit(9999))
    with pytest.raises(ValueError, match="inconsistent"):
        P.merged(both.unionByName(other))
    assert P.merged(both.unionByName(other), drop_conflicts=True)[1]["conflicts"] == 1
    with pytest.raises(ValueError, match="across splits"):
        P.merged(both.withColumn("split", F.when(F.col("uid") == first["uid"], "val").otherwise(F.col("split"))))


def test_comparisons_refuse_and_note(spark):
    rows = [("a", k, k % 4, float(k % 5), 5.0) for k in range(20)] + [("b", k, k % 4, float(k % 5) + 1, 5.0) for k in range(2, 22)]
    out = C.against(spark.createDataFrame(rows, "system string, item long, cluster long, num double, den double"), "system", "a", ["item", "cluster"], "cluster", "lower").first()
    assert (out["pairs"], out["only_baseline"], out["only_system"], out["verdict"]) == (18, 2, 2, "loss") and abs(out["delta"] - 0.2) < 1e-12
    with pytest.raises(ValueError, match="nothing in common"):
        C.against(spark.createDataFrame([("a", 1, 1, 1.0, 1.0), ("b", 2, 1, 1.0, 1.0)], "system string, item long, cluster long, num double, den double"), "system", "a", ["item"], "cluster")
    scored = spark.createDataFrame([("a", {"asr": "x"}), ("b", {"asr": "y"}), ("c", None)], "system string, evaluator map<string,string>")
    with pytest.raises(ValueError, match="asr: a=x, asr: b=y"):
        C.check_scorers(scored, "system", "evaluator")
    assert len(C.check_scorers(scored, "system", "evaluator", True)) == 2 and C.check_scorers(scored.filter("system = 'a'"), "system", "evaluator") == []
    before = spark.createDataFrame([(k, k % 3, "t", 1.0 + k) for k in range(9)], "uid long, speaker long, text string, wer double")
    better = before.withColumn("wer", F.col("wer") - 1 - F.col("uid") % 2)
    change = C.gate(before, better, ["uid"], "speaker", ["wer"], ["text"]).first()
    assert change["high"] < 0 and change["clusters"] == 3
    for worse, what in ((better.limit(8), "keys"), (better.withColumn("text", F.lit("x")), "changed"), (better.withColumn("wer", F.lit(float("nan"))), "finite"), (better.union(better.limit(1)), "duplicate")):
        with pytest.raises(ValueError, match=what):
            C.gate(before, worse, ["uid"], "speaker", ["wer"], ["text"])


def test_interval_coverage_and_bootstrap(spark):
    r = np.random.default_rng(4)  # parts whose clusters share one rate: intervals hold it about as often as they say
    cells = [(g, c, float(r.binomial(60, 0.2)), 60.0) for g in range(80) for c in range(12)]
    got = {x["method"]: x["covered"] for x in I.covered(spark.createDataFrame(cells, "g long, c long, num double, den double"), "g", "c").collect()}
    assert got["jackknife_t"] >= got["percentile"] and got["jackknife_t"] > 0.88
    two = I.bootstrap(spark.createDataFrame([("s", 1, 4.0, 8.0), ("s", 2, 0.0, 8.0), ("one", 1, 1.0, 0.0)], "s string, c long, num double, den double"), ["s"], "c", 4000).toPandas()
    values, n = np.unique(two[two.s == "s"].estimate, return_counts=True)
    assert values.tolist() == [0.0, 0.25, 0.5] and np.allclose(n / 4000, [0.25, 0.5, 0.25], atol=0.03)
    assert two[two.s == "one"].estimate.isna().all() and (two.s == "one").sum() == 4000
    q = catalogue.queries()
    for r in q["bootstrap"](spark, SF).collect():
        assert r["low"] < r["estimate"] < r["high"]
    wide = {r["system"]: r for r in q["jackknife_intervals"](spark, SF).collect()}
    for r in q["jackknife"](spark, SF).collect():
        half = I.t_quantile(0.975, r["clusters"] - 1) * r["error"]
        assert abs(wide[r["system"]]["low"] - (r["estimate"] - half)) < 1e-12
    assert [r[0] for r in spark.createDataFrame([(1.0, 2.0), (-1.0, 1.0), (-2.0, -1.0), (None, 1.0)], "a double, b double").select(I.verdict(F.col("a"), F.col("b"))).collect()] == ["win", "tie", "loss", "n/a"]


def test_draws_of_one_group_are_dealt_over_tasks(spark, monkeypatch):
    """A thousand clusters of one group in one partition: their draws are made by many tasks, each hashed once, and looked up right."""
    monkeypatch.setattr(I, "DRAWS", 20_000)

    def u(text):
        return int(hashlib.sha256(text.encode()).hexdigest()[:16], 16) / 2**64

    rows = spark.range(0, 1000, 1, 1).select(F.lit("s").alias("s"), F.col("id").alias("place"), F.lit(1000).alias("n"))
    made = I.picks(rows, ["s"], 200).groupBy(F.spark_partition_id()).agg(F.count("*"), F.max("place"), F.min("place")).collect()
    assert len(made) == 10 and sum(r[1] for r in made) == 200_000 and max(r[1] for r in made) < 40_000
    assert max(r[2] for r in made) == 999 and min(r[3] for r in made) == 0
    cells = [("s", c, float(c % 7), 5.0 + c % 3) for c in range(1000)] + [("t", c, 1.0 + c, 4.0) for c in range(3)]
    df = I.bootstrap(spark.createDataFrame(cells, "s string, c long, num double, den double"), ["s"], "c", 25)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    got = {(r["s"], r["replicate"]): r["estimate"] for r in df.collect()}
    assert len(got) == 50
    for s in "st":
        group = sorted((u(f"0:{c}"), num, den) for g, c, num, den in cells if g == s)
        for b in range(25):
            drawn = [group[int(u(f"0:{s}:{b}:{p}") * len(group))] for p in range(len(group))]
            assert abs(got[s, b] - sum(d[1] for d in drawn) / sum(d[2] for d in drawn)) < 1e-12


def plain_components(edges):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(p)}


@pytest.mark.parametrize("rows", [50_000, 150])
def test_components_to_convergence(spark, monkeypatch, rows):
    """A shuffled chain of 600 nodes and loose ends, in one partition and in several."""
    monkeypatch.setattr(graph, "ROWS", rows)
    r = random.Random(7)
    edges = [(i, i + 1) for i in r.sample(range(600), 600)] + [(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(150)]
    got = {x["node"]: x["comp"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_components([e for e in edges if e[0] != e[1]])


def test_stars_of_a_large_partition_are_folded(monkeypatch):
    monkeypatch.setattr(graph, "HELD", 100)
    seen = []
    monkeypatch.setattr(graph, "local_stars", lambda u, v, whole=graph.local_stars: (seen.append(len(u)), whole(u, v))[1])
    r = random.Random(3)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(1000)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(300)]
    frames = [pd.DataFrame(edges[i : i + 40], columns=["u", "v"]) for i in range(0, len(edges), 40)]
    stars = pd.concat(graph._local(iter(frames)))
    assert max(seen) <= 140
    assert plain_components([e for e in edges if e[0] != e[1]]) == plain_components(list(stars.itertuples(index=False, name=None)))


def test_contamination_beyond_the_broadcast(spark, monkeypatch):
    """Without a broadcast the same rows: equal, contained, near from either side, and sentences shorter than a gram."""
    r = random.Random(12)
    word = lambda: r.choice("abcdefghijkl")
    held = [" ".join(word() for _ in range(r.randint(1, 14))) for _ in range(60)]
    docs = []
    for s in held:
        w = s.split()
        docs += [s, f"{word()} {s} {word()}", " ".join(w[:-1]), " ".join([*w, *(word() for _ in range(3))]), " ".join(x if r.random() > 0.1 else "zz" for x in w)]
    docs += ["", "a", "a b", *(" ".join(word() for _ in range(20)) for _ in range(40))]
    left = spark.createDataFrame(list(enumerate(docs)), "key long, norm string")
    right = spark.createDataFrame([(s,) for s in [*held, held[0], ""]], "norm string")
    want = sorted(map(tuple, curate.contaminated(left, right).collect()))
    monkeypatch.setattr(curate, "BROADCAST_GRAMS", 0)
    assert sorted(map(tuple, curate.contaminated(left, right).collect())) == want and {x[1] for x in want} == {"exact", "contains", "near"}


@pytest.mark.parametrize("block", [7, 4000])
def test_similarity_join_prunes_and_stays_exact(spark, monkeypatch, block):
    """Clusters, equal vectors and a cluster larger than a block; fewer blocks meet as the threshold rises."""
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    monkeypatch.setattr(V, "FOR_PIVOT", 10)
    r = np.random.default_rng(5)
    middle = r.standard_normal((8, 16))
    x = np.concatenate([middle[k] + 0.15 * r.standard_normal((40 if k == 0 else 15, 16)) for k in range(8)])
    x[50] = x[60] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uid long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for t in (0.3, 0.9):
        got = {(p["a"], p["b"]) for p in V.similar_pairs(df, "uid", "v", t).collect()}
        assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if u[i] @ u[j] >= t and not {i, j} & {50, 60}} | {(3, 50), (3, 60)}
    assert V.meetings(df, "uid", "v", 0.9) < V.meetings(df, "uid", "v", 0.5) < V.meetings(df, "uid", "v", -1.0)
    near = {n["uid"]: n["nearest"] for n in V.nearest(df.filter("uid % 3 = 0"), df.filter("uid % 3 != 0"), "uid", "v").collect()}
    right = [j for j in range(len(x)) if j % 3]
    assert near == {i: right[int((x[i] @ x[right].T).argmax())] for i in range(0, len(x), 3)}
    assert V.similar_pairs(df.limit(0), "uid", "v", 0.5).count() == 0 and V.nearest(df, df.limit(0), "uid", "v").count() == 0


def test_similarity_join_sends_a_row_once_a_bundle(spark, monkeypatch):
    """Where pruning does nothing, rows travel by bundles, not by cells, and products come in bounded strips."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 5)
    monkeypatch.setattr(V, "FOR_PIVOT", 8)
    x = np.random.default_rng(8).standard_normal((300, 12))
    groups = V._Groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"))
    near, bundles = V._by_angle(groups, -1.0), int(groups.bundle.max()) + 1
    assert len(groups.group) > 3 * bundles
    assert V._together(groups.homes, groups, near, True).count() <= 300 * (bundles + 1)
    monkeypatch.setattr(V, "STRIP", 64)
    cell = np.repeat(np.arange(30), 10)
    parts = [s.size for *_, s in V._products(x, None, x, cell, lambda v: np.ones((len(v), 30), bool), np.arange(30))]
    assert max(parts) <= 64 and sum(parts) == 300 * 300


def test_average_linkage_of_large_components(spark, monkeypatch):
    """In rounds over tables and then over links at hand, the same clusters as one pair after the other; copies of a vector too."""
    monkeypatch.setattr(V, "SMALL", 3)
    monkeypatch.setattr(V, "LINKS", 250)
    r = np.random.default_rng(11)
    middle = r.standard_normal((6, 10))
    x = np.concatenate([middle[k] + 0.8 * r.standard_normal((25, 10)) for k in range(6)])
    x[10] = x[20] = x[70] = x[3]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    owner = V.average_linkage(u @ u.T, 0.4)
    got = {c["node"]: c["cluster"] for c in V.average_clusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uid long, v array<double>"), "uid", "v", 0.4).collect()}
    assert got == dict(enumerate(owner.tolist())) and 6 <= len(set(owner)) < 60


def test_average_linkage_in_many_rounds(spark, monkeypatch):
    """Neighbours on an arc merge in turn, round after round, over several blocks: Spark's estimate of the result's size stays that of a table, and no table is left."""
    monkeypatch.setattr(V, "SMALL", 3)
    monkeypatch.setattr(V, "LINKS", 5)
    monkeypatch.setattr(V, "WIDE", 7, raising=False)
    monkeypatch.setattr(V, "HELD", 40, raising=False)
    turn = np.cumsum(0.02 * 1.25 ** np.arange(14))
    u = np.stack([np.cos(turn), np.sin(turn)], 1)
    u[10] = u[4]
    left = set(glob.glob(f"{folder(spark).removeprefix('file:')}/tables-*"))
    df = V.average_clusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "uid long, v array<double>"), "uid", "v", 0.5)
    size = df._jdf.queryExecution().optimizedPlan().stats().simpleString()
    assert size.endswith("iB") or float(size.removeprefix("sizeInBytes=").removesuffix(" B")) < 1e60
    assert {c["node"]: c["cluster"] for c in df.collect()} == dict(enumerate(V.average_linkage(u @ u.T, 0.5).tolist()))
    assert set(glob.glob(f"{folder(spark).removeprefix('file:')}/tables-*")) <= left


def test_vectors_against_plain(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((60, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uid long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = V.nearest(df.filter("uid < 20"), df.filter("uid >= 20"), "uid", "v").collect()
    assert {n["uid"]: n["nearest"] for n in near} == {i: int((x[i] @ x[20:].T).argmax()) + 20 for i in range(20)}
    pairs = {(p["a"], p["b"]) for p in V.similar_pairs(df, "uid", "v", 0.5).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.5}
    sim = u @ u.T
    owner, clusters = V.average_linkage(sim, 0.3), {i: [i] for i in range(60)}
    while len(clusters) > 1:  # the definition: the two clusters with the greatest mean similarity merge
        s, i, j = max((sim[np.ix_(a, b)].mean(), i, j) for i, a in clusters.items() for j, b in clusters.items() if i < j)
        if s < 0.3:
            break
        clusters[i] += clusters.pop(j)
    assert {tuple(sorted(c)) for c in clusters.values()} == {tuple(np.flatnonzero(owner == o)) for o in set(owner.tolist())}
    got = catalogue.queries()["average_linkage"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def _cases_hold(rows, got, session=True, spans=True):
    """Pairs are right, nothing is used twice, and no pair could be added. Rows: speaker, uid, digest, rec, start, end, session."""
    by = {x[1]: x for x in rows}
    meet = lambda a, b: spans and None not in (a[3], b[3]) and a[3] == b[3] and a[4] < b[5] and b[4] < a[5]
    apart = lambda a, b: a[0] == b[0] and a[2] != b[2] and not meet(a, b) and (not session or bool(a[6] and b[6] and a[6] != b[6]))
    used = [by[u] for pair in got for u in pair]
    assert len({x[1] for x in used}) == len(used) == len({x[2] for x in used})
    assert not any(meet(a, b) for i, a in enumerate(used) for b in used[:i])
    assert all(apart(by[t], by[ref]) for t, ref in got)
    digests = {x[2] for x in used}
    free = [x for x in rows if x[0] and x[2] not in digests and not any(meet(x, u) for u in used)]
    assert not any(apart(a, b) for i, a in enumerate(free) for b in free[:i])


def test_moments_of_odd_vectors(spark):
    rows = [([1.0, 2.0],), ([3.0, 4.0],), (None,), ([5.0],), ([],)]
    got = V.partial_moments(spark.createDataFrame(rows, "v array<double>").repartition(3), "v").groupBy("i", "j").sum("product", "total", "n").collect()
    assert {tuple(g) for g in got} == {(0, 0, 35.0, 9.0, 3), (0, 1, 14.0, 4.0, 2), (1, 1, 20.0, 6.0, 2)}


def test_cases_use_nothing_twice(spark):
    kind = "speaker string, uid long, digest string, rec string, start double, end double, session string"
    pairs = lambda d: [(g["uid"], g["reference"]) for g in d.collect()]
    for seed in (5, 6):
        r = random.Random(seed)
        rows = [(r.choice(["s0", "s0", "s1", "s2", None]), i, f"d{r.randrange(70)}", r.choice(["r0", "r1", "r2", None]), (a := r.random() * 100), a + r.choice([0.01, 1, 5, 40]), r.choice(["m", "m", "m", "n", "o", None])) for i in range(120)]
        df = spark.createDataFrame(rows, kind)
        got = pairs(greedy_cases(df, "speaker", "uid", "digest", seed, "session", "rec"))
        assert got
        _cases_hold(rows, got)
        assert sorted(got) == sorted(pairs(greedy_cases(df.repartition(7, "digest"), "speaker", "uid", "digest", seed, "session", "rec")))
    _cases_hold(rows, pairs(greedy_cases(df, "speaker", "uid", "digest", 1)), session=False, spans=False)
    assert greedy_cases(df, "speaker", "uid", "digest", 1, limit=3).count() == 3
    assert greedy_cases(df.limit(0), "speaker", "uid", "digest", 1, "session", "rec").count() == 0


def test_cases_where_few_rows_can_pair(spark):
    kind = "speaker string, uid long, digest string, rec string, start double, end double, session string"
    pairs = lambda d: [(g["uid"], g["reference"]) for g in d.collect()]
    one_session = [("s", i, f"d{i}", None, None, None, "m") for i in range(200)] + [("s", 500 + i, "d3", None, None, None, "n") for i in range(3)] + [("s", 900, "x", None, None, None, "o")]
    got = pairs(greedy_cases(spark.createDataFrame(one_session, kind), "speaker", "uid", "digest", 0, "session"))
    _cases_hold(one_session, got)
    assert len(got) in (1, 2)
    # every row overlaps every other of its recording, but for one
    heap = [("s", i, f"d{i}", "r", 0.0, 50.0 + i, "m") for i in range(70)] + [("t", 99, "q", "r", 60.0, 70.0, "m"), ("s", 100, "z", "r", 200.0, 201.0, "m")]
    got = pairs(greedy_cases(spark.createDataFrame(heap, kind), "speaker", "uid", "digest", 0, None, "rec"))
    _cases_hold(heap, got, session=False)
    assert len(got) == 1
    with pytest.raises(Exception, match="invalid source interval"):
        greedy_cases(spark.createDataFrame([("s", 1, "d", "r", 3.0, 2.0, "m")], kind), "speaker", "uid", "digest", 0, None, "rec")


def test_specifications(spark):
    assert specs.parse_selection("cer,wer").weights is None and specs.parse_selection("cer:10,dnsmos:1").weights == (10.0, 1.0)
    for bad in ("", "cer,cer", "nope", "cer:1,wer", "cer:inf"):
        with pytest.raises(ValueError):
            specs.parse_selection(bad)
    assert specs.parse_pairs("a=1,b=x=y") == {"a": "1", "b": "x=y"}
    for bad in ("a", "=1", "a=1,a=2"):
        with pytest.raises(ValueError):
            specs.parse_pairs(bad)
    df = spark.createDataFrame([("ep1_speaker_0",)], "l string")
    for pattern, want in ((r"^(?P<key>.+)_speaker_\d+$", "ep1"), (r"^(.+)_speaker_\d+$", "ep1"), (r"ep\d", "ep1")):
        assert df.select(specs.split_key(F.col("l"), pattern)).first()[0] == want
    with pytest.raises(Exception, match="no split key"):
        df.select(specs.split_key(F.col("l"), r"^x(.+)$")).collect()
    assert specs.load("math:sqrt")(9) == 3
    for bad in ("math", "math:", "math:pi", "math:nope"):
        with pytest.raises(ValueError):
            specs.load(bad)
    assert specs.model_family("openai/Whisper-large") == "whisper"
    odd = spark.createDataFrame([("a=1, b=x=y,, =3,c,a=2",), ("",), (None,)], "t string").select(specs.named_values(F.col("t")).alias("v")).collect()
    assert [tuple(x) for x in odd[0]["v"]] == [("a", "1", "repeated"), ("b", "x=y", None), ("", "3", "no name"), (None, None, "no name"), ("a", "2", "repeated")]
    assert odd[1]["v"] == [] and odd[2]["v"] is None


def pool_of(settings=2):
    return lambda texts: [[float(len(t)), float(settings)] for t in texts]


def lengths(frame):
    return frame["t"].str.len()


def test_hooks(spark):
    df = spark.createDataFrame([(1, "g", "a"), (2, "g", "bbb"), (3, "h", "cc")], "k long, g string, t string")
    got = {r["k"]: r["embedding"] for r in hooks.embedded(df, "tests.test_engine:pool_of", "k", "t", settings=7).collect()}
    assert got == {1: [1.0, 7.0], 2: [3.0, 7.0], 3: [2.0, 7.0]}
    made = hooks.built("tests.test_engine:pool_of", "array<double>", settings=1)
    assert df.select(made(F.col("t")).alias("x")).first()["x"] == [1.0, 1.0]
    terms = hooks.group_terms(df, "g", "k", {"up": ("tests.test_engine:lengths", 1, -9), "down": ("tests.test_engine:lengths", -1, -2)}, ["t"]).collect()
    assert {r["k"]: (r["up"], r["down"]) for r in terms} == {1: (1, -1), 2: (3, -2), 3: (2, -2)}
    hooks.register(spark)
    df.createOrReplaceTempView("hook_texts")
    assert spark.sql("SELECT k, i, pause FROM hook_texts, LATERAL split_sentences(t)").count() == 3


def test_arrays_refuse(spark):
    df = spark.createDataFrame([([1.0] * 20,)], "x array<double>")
    with pytest.raises(Exception, match="rate"):
        df.select(A.pooled(F.col("x"), 4, F.lit(20))).collect()
    assert df.select(A.pooled(F.col("x"), 4, F.lit(6))).first()[0] == [1.0] * 6  # four missing ones repeat the last
    t = A.assembled(F.array(*map(F.lit, (1, 9, 3))), F.array(*map(F.lit, (1, 7, 8, 3))), "joined")
    assert df.select(t.alias("t")).first()["t"][:] == ([1, 9, 36, 7, 8, 3], [1] * 6)


def test_ridge_and_components(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((200, 3))
    y = 2 + x @ [1.0, -2.0, 0.5] + 0.01 * r.standard_normal(200)
    df = spark.createDataFrame([(*map(float, row), float(v), [*map(float, row)]) for row, v in zip(x, y, strict=True)], "a double, b double, c double, y double, v array<double>")
    w = duration.ridge(df, [F.lit(1.0), F.col("a"), F.col("b"), F.col("c")], F.col("y"), 1e-3)
    full = np.column_stack([np.ones(200), x])
    assert np.allclose(w, np.linalg.solve(full.T @ full + np.diag([0, 0.2, 0.2, 0.2]), full.T @ y))
    mean, parts, share = duration.principal_components(df, "v", 3, 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs(parts), np.abs(vectors[:, ::-1][:, :2].T)) and np.allclose(share, values[::-1][:2] / values.sum())
    projected = np.array([p[0] for p in df.select(A.projected(F.col("v"), mean.tolist(), parts.tolist())).collect()])
    assert np.allclose(np.sort(projected[:, 0]), np.sort((x - mean) @ parts[0]))


def test_batch_packing(spark):
    """By the definition: rows of a bucket by cost, cut at 16 rows or where the longest times the rows with one more passes the budget."""
    docs = {r["doc_id"]: r["n_chars"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in catalogue.queries()["batch_packing"](spark, SF).collect():
        got.setdefault((r["bucket"], r["batch"]), []).append(docs[r["doc_id"]])
    assert sum(map(len, got.values())) == len(docs)
    for costs in got.values():
        assert len(costs) <= 16 and (len(costs) == 1 or max(costs) * len(costs) <= 60_000)


def test_rates_of_turns(spark):
    import re

    from tests.test_functions import table_edits

    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], re.sub(r"[^a-z0-9'\s]", " ", r["text"].lower().replace("’", "'")).split()))
    got = {r["conv_id"]: r for r in catalogue.queries()["cer_wer"](spark, SF).collect()}
    for conv in sorted(turns)[:3]:
        seq = [w for _, w in sorted(turns[conv])]
        pairs = [(a, b) for a, b in zip(seq, seq[1:], strict=False) if a]
        if pairs and all(len(a) < 80 and len(b) < 80 for a, b in pairs):
            assert abs(got[conv]["wer"] - sum(sum(table_edits(a, b)) for a, b in pairs) / sum(len(a) for a, _ in pairs)) < 1e-12


def test_stream_restarts_without_copies(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = lambda: shards.arriving(spark, f"{tmp_path}/in", "id long", 1)
    both = {"one": lambda df: df, "two": lambda df: df.groupBy().count()}
    shards.run_available(source(), both, f"{tmp_path}/out", f"{tmp_path}/marks")
    shards.run_available(source(), both, f"{tmp_path}/out", f"{tmp_path}/marks")
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    shards.run_available(source(), both, f"{tmp_path}/out", f"{tmp_path}/marks")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out/one").collect()) == list(range(15))
    assert sorted(r["count"] for r in spark.read.parquet(f"{tmp_path}/out/two").collect()) == [5, 10]
    score = lambda df: df.withColumn("s", F.lit(1.0))
    assert [shards.poll(spark.range(4).union(spark.range(n)), score, f"{tmp_path}/poll", ["id"]) for n in (2, 6, 6)] == [4, 2, 0]

    # a poll killed after it wrote and before its batch was committed, and one killed before its files were listed
    for lost in (("marks/commits", "done/_spark_metadata"), ("marks/commits",)):
        for folder in lost:
            newest = max((f for f in os.listdir(tmp_path / "poll" / folder) if f.isdigit()), key=int)
            for name in (newest, f".{newest}.crc"):
                (tmp_path / "poll" / folder / name).unlink(missing_ok=True)
        assert shards.poll(spark.range(7, 9), score, f"{tmp_path}/poll", ["id"]) >= 0
        ids = [r["id"] for r in spark.read.parquet(f"{tmp_path}/poll/done").collect()]
        assert sorted(ids) == sorted({*range(6), 7, 8})


def test_selected_over_frames(spark):
    """Groups that lie across the frames of a task are whole."""
    rows = [(g, k, (g * 7 + k * 5) % 11) for g in range(50) for k in range(1 + g % 9)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = hooks.selected(spark.createDataFrame(rows, "g long, k long, l_quantity long"), "g", "k", "lexloom.plans.speaking:most_quantity", ["l_quantity"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["g"]: r["k"] for r in got} == {g: max((k for h, k, _ in rows if h == g), key=lambda k: ((g * 7 + k * 5) % 11, -k)) for g in range(50)}


def test_side_stores_refuse(spark):
    part = lambda *ids: spark.createDataFrame([(i,) for i in ids], "k long")
    meta = lambda p, **more: {"complete": True, "partition": p, "partitions": 2, "source": "x", "dims": 4, **more}
    assert P.side_store([(part(1, 2), meta(0)), (part(3), meta(1))], ["dims"], ["k"]).count() == 3
    for parts, what in (
        ([(part(1), meta(0))], "missing"), ([(part(1), meta(0)), (part(2), meta(1, complete=False))], "incomplete"),
        ([(part(1), meta(0)), (part(2), meta(1, dims=8))], "incompatible"), ([(part(1), meta(0)), (part(1), meta(1))], "two parts have"),
    ):
        with pytest.raises(ValueError, match=what):
            P.side_store(parts, ["dims"], ["k"])


def test_quota_backfills(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(12)], "i long, g string")
    got = {r["i"] for r in curate.quota(df, "g", ["i"], 4, 8).collect()}
    assert got == {0, 1, 2, 3, 4, 5, 6, 7}
    assert {r["i"] for r in curate.quota(df, "g", ["i"], 2, 4).collect()} == {0, 1, 3, 4}


def test_broken_intervals(spark):
    rows = [(1, 1, 0.0, 5.0), (1, 2, 4.0, 6.0), (1, 3, 5.0, 7.0), (1, 4, -1.0, 2.0), (1, 5, 3.0, 3.0), (1, 6, float("nan"), 3.0), (1, 7, 1.0, float("inf")), (1, 8, None, 2.0), (2, 9, 0.0, 9.0)]
    broken, pairs = I_ranges.checked_overlaps(spark.createDataFrame(rows, "k long, u long, s double, e double"), "k", "u", "s", "e", 2.0)
    assert {r["u"] for r in broken.collect()} == {4, 5, 6, 7, 8}
    assert {(r["left_id"], r["right_id"]) for r in pairs.collect()} == {(1, 2), (2, 3)}


def test_lag_rate_median_counts_every_gap(spark):
    n = {x["user_id"]: x["k"] for x in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg((F.count("*") - 1).alias("k")).collect()}
    assert {x["user_id"]: x["n"] for x in catalogue.queries()["lag_rate_median"](spark, SF).collect()} == n


def test_partners_and_rows_before_of_a_large_group(spark):
    """Work that is linear in a group: 120,000 rows of one source; stretches without eligible rows and a null source among them."""
    df = spark.range(120_000).selectExpr("id * 7 as uid", "if(id % 1000 = 0, null, 'a') as g")
    for g, n in (("a", 119_880), (None, 120)):
        got = S.circular_partner(df, "g", "uid", 3).filter(F.col("g").eqNullSafe(g)).toPandas()
        step = dict(zip(got.uid, got.partner, strict=True))
        at, seen = next(iter(step)), 0
        while seen < n:
            at, seen = step[at], seen + 1
            if at == got.uid[0]:
                break
        assert seen == n == len(step)
    few = S.circular_partner(df.limit(3000), "g", "uid", 3, F.col("uid") % 700 == 0)
    assert few.filter("g = 'a' and partner % 700 != 0").isEmpty() and few.filter("g = 'a'").count() == 2997
    before = {x["uid"]: x["before"] for x in S.previous(df, "g", "uid").filter("g = 'a'").collect()}
    ids = sorted(before)
    assert before == dict(zip(ids, [None, *ids[:-1]], strict=True))
