"""Byte-level BPE, centroid clustering and turn reassembly against plain versions."""

import hashlib
import random
import time

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexloom.llm import bpe, clusters, language, turns
from lexloom.llm.mixing import mix_sources
from lexloom.llm.queries import BLANK_OR_RUN, op13_byte_bpe, ranks_path
from lexloom.llm.urls import judge_urls


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder.load(ranks_path(), BLANK_OR_RUN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=BLANK_OR_RUN, mergeable_ranks=coder.ranks, special_tokens={})


def strange_texts():
    r = random.Random(3)
    bits = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "\x1c", "　", "é", "日本", "1", "23", "!", "'s", "don't", "😀", "x" * 30]
    made = ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(400)]
    return ["", " ", "a" * 5000, "ab" * 3000, " \n x  y\n z \n", "tail   ", "".join(r.choice("abcdefg") for _ in range(20_000)), *made]


def test_bpe_equals_the_library(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 40)
    monkeypatch.setattr(bpe, "MEMO", 50)
    for text in strange_texts():
        ids = coder.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_takes_a_lesser_rank_first():
    """A merge can bring up a pair of lesser rank while positions of its own rank are left."""
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"ab": 9, b"abc": 5, b"cab": 7}
    assert bpe.merge(ranks, b"abcab") == [5, 9]
    plain = [bytes([b]) for b in b"cabcabab"]
    while True:
        best = min(((ranks.get(a + b, 999), i) for i, (a, b) in enumerate(zip(plain, plain[1:], strict=False))), default=(999, 0))
        if best[0] == 999:
            break
        plain[best[1] : best[1] + 2] = [plain[best[1]] + plain[best[1] + 1]]
    assert bpe.merge(ranks, b"cabcabab") == [ranks[p] for p in plain]


def test_bpe_rows(spark, coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "IDS", 5)
    texts = [None, "", "one two", "one two", "word " * 3000]
    rows = spark.createDataFrame([(i if i != 2 else None, t, "kept", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    got = bpe.round_trip(rows, coder, ()).collect()
    assert [None if r["ids"] is None else list(r["ids"]) for r in got] == [None if t is None else library.encode_ordinary(t) for t in texts]
    assert [r["decoded"] and bytes(r["decoded"]).decode() for r in got] == [t and (t or b"") for t in [None, b"", *texts[2:]]]
    back = bpe.decode(bpe.encode(rows.withColumnRenamed("ids", "rep"), coder, ("rep",)), coder, ("rep",)).select("rep", F.col("decoded").cast("string").alias("t")).collect()
    assert [r["t"] for r in back] == texts and {r["rep"] for r in back} == {"kept"}
    assert bpe.round_trip(rows.limit(0), coder).count() == 0


def test_bpe_query(spark, library, tmp_path):
    texts = [None, "", "Größe 12 don't\n\nstop", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op13_byte_bpe(spark, str(tmp_path)).collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids)).encode()), digest(text.encode()))


def plain_clusters(points, k, rounds):
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in points if i is not None)[:k]  # ids suffice here
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), z) for z, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in points]
        for z in range(len(c)):
            mine = [v for (_, v), w in zip(points, own, strict=True) if w == z]
            if mine:
                c[z] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in points), key=str), c


def test_clusters_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(clusters, "ROWS", 64)
    monkeypatch.setattr(clusters, "LEAF", 4)
    r = random.Random(2)
    vector = lambda spread: [r.gauss(0, 1) * spread + r.choice([-3.0, 0.0, 3.0]) for _ in range(4)]
    rows = [(i, vector(0.1 if i % 3 else 0.0)) for i in range(300)]  # many equal vectors, so many ties
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (400, [1.0, 2.0]), (401, None), (402, [1.0, None, 0.0, 0.0]), (403, [1.0, float("nan"), 0.0, 0.0]), (404, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*x, 5, "c") for x in rows], "vec_id long, embedding array<double>, distance int, cluster string").repartition(3)
    points = clusters.quantised(df, "vec_id", "embedding", 4, 64.0)
    members, c = clusters.cluster(points, 9, 3)
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    want, centroids = plain_clusters(good, 9, 3)
    assert sorted((tuple(x) for x in members.collect()), key=str) == want and c.tolist() == centroids
    out = clusters.report(members, c).collect()
    total = {z: sum(d for _, w, d in want if w == z) for z in range(9)}
    assert all(x["cluster_inertia"] == total[x["cluster"]] and x["inertia"] == sum(total.values()) for x in out)
    assert all(x["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[x["cluster"]])).encode()).hexdigest() for x in out)


def test_clusters_prune_and_assign_whole_nodes():
    """Far groups are settled by nodes; what a walk adds to clusters equals what its vectors add."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-5, 5, (700, 3)) + shift for shift in ([0, 0, 0], [1000, 0, 0], [0, 1000, 0])])
    x = x[clusters.build(x)]
    c = np.array([[0, 0, 0], [1000, 0, 0], [0, 1000, 0], [0, 0, 0]])  # the last one ties with the first and never wins
    owner, parts = clusters.walk(x, clusters.summary(x), c)
    assert (owner == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()
    assert max(n for _, n, _ in parts) > clusters.LEAF
    for z in range(3):
        assert sum(n for w, n, _ in parts if w == z) == (owner == z).sum() and (sum(s for w, _, s in parts if w == z) == x[owner == z].sum(0)).all()


def test_clusters_of_few_or_none(spark):
    few = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.1, 0.2])], "vec_id long, embedding array<float>")
    members, c = clusters.cluster(clusters.quantised(few, "vec_id", "embedding", 2, 64.0), 16, 3)
    assert len(c) == 2 and members.count() == 2
    members, c = clusters.cluster(clusters.quantised(few.limit(0), "vec_id", "embedding", 2, 64.0), 16, 3)
    assert clusters.report(members, c).count() == 0
    with pytest.raises(Exception, match="too large"):
        clusters.quantised(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", 2, 64.0).collect()


def plain_turns(rows, batches, patience):
    """The rules, read off one batch after the other."""
    out, state = [], {}
    first = {}
    for c, t, *_ in rows:
        if t is not None:
            first[c] = min(t, first.get(c, t))
    for b in range(batches + 1):
        came = {}
        for c, t, role, body, batch in rows:
            if t is not None and batch == b:
                came.setdefault(c, {}).setdefault(t, []).append((body or "", role or ""))
        for c in {*came, *state}:
            s = state.setdefault(c, {"kept": {}, "released": set(), "closed": False, "seen": b})
            for t, all_ in came.get(c, {}).items():
                body, role = min(all_)
                if s["closed"]:
                    out.append(("reject", c, t, b, role, body, None, None, None))
                    continue
                s["seen"] = b
                s["kept"].setdefault(t, (role, body))
            t = first[c]
            while t in s["kept"] and not s["closed"]:
                if t not in s["released"]:
                    s["released"].add(t)
                    out.append(("release", c, t, b, *s["kept"][t], None, None, None))
                t += 1
            if not s["closed"] and (b == batches or b - s["seen"] >= patience):
                s["closed"] = True
                kept = s["kept"]
                missing = sum(t not in kept for t in range(first[c], max(kept) + 1))
                breaks = sum(t - 1 in kept and kept[t - 1][0] == kept[t][0] for t in kept)
                out.append(("close", c, -1, b, None, None, tuple(sorted({*kept} - s["released"])), missing, breaks))
    return sorted(out, key=str)


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_turns_equal_the_rules(spark):
    r = random.Random(4)
    rows = []
    for c in [None, *range(40)]:
        for _ in range(r.randint(1, 9)):
            rows.append((c, r.randint(3, 9), r.choice(["user", "assistant", None, ""]), r.choice(["a", "b|c", None, "é"]), r.choice([0, 0, 1, 2, 5, 6]) if c != 5 else 0))  # no arrivals at all in 3 and 4
    rows += [rows[3], (9, None, "user", "x", 0), (77, -2, "user", "z", 6), (78, 10**12, "user", "far", 0), (78, 10**12 + 2, "user", "off", 0)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "conv_id long, turn long, role string, body string, batch int, first string").repartition(3)
    got = sorted((tuple(tuple(v) if isinstance(v, list) else v for v in x) for x in turns.reassemble(df, 7, 2).collect()), key=str)
    assert got == plain_turns(rows, 7, 2)
    assert {"release", "reject", "close"} == {x[0] for x in got}


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_turns_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.reassemble(turns.deliveries(none, 2), 2).count() == 0


def test_deliveries(spark):
    rows = [(1, 0, None, "t"), (1, 1, "user", None), (1, None, "user", "x"), *((2, i, "assistant", str(i)) for i in range(200))]
    got = sorted(tuple(x) for x in turns.deliveries(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = []
    for c, t, role, text in rows:
        if t is not None:
            h = int(hashlib.sha256(f"{c}:{t}".encode()).hexdigest()[:8], 16)
            want.append((c, t, role or "", f"{role or ''}|{text or ''}", h % 12))
            if h % 7 < 2:
                want.append((c, t, "user", f"user|{text or ''}", (h + 3) % 12))
    assert got == sorted(want)


def test_mix_of_rows_that_share_an_id(spark):
    """Ties of id and size: any partitions give the same rows, null ids too."""
    texts = [f"{'abcdefghij'[i % 10]}{i} two three" for i in range(40)]
    rows = [(None if i % 5 == 0 else 7, "s" if i % 3 else "t", t, "en") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string")
    got = [sorted(tuple(r) for r in mix_sources(df.repartition(n), keep=("text", "lang")).select("text", "copies").collect()) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 40


def test_long_urls(spark):
    """Time grows with the url, not with its square; repeated rows and further columns are ordinary."""
    rules = [("allow", "net", "/"), ("block", "net", "/abc"), ("block", "net", "/abc/d")]
    long = "http://x.net/abc" + "z" * 2_000_000
    start = time.time()
    rows = judge_urls(spark.createDataFrame([(1, long, "r"), (1, long, "r"), (2, "http://net/ab", "r"), (3, "http://net/abc/de", "r")], "page_id long, url string, rule string"), rules).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in rows) == [(1, "net/abc", "block"), (1, "net/abc", "block"), (2, "net/", "allow"), (3, "net/abc/d", "block")]
    assert time.time() - start < 30


def test_too_many_languages_are_refused_before_they_are_counted(spark):
    rows = spark.createDataFrame([(i, "text", f"l{i}") for i in range(50)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="50 languages"):
        language.fit(rows, max_bytes=1 << 20)
