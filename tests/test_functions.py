import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import expr, reading
from lexloom.functions.alignment import edit_kinds, edit_kinds_of, word_edits
from lexloom.operators import curate, intervals, quantiles, ranges
from lexloom.operators.order import places


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_number_words(spark):
    pins = {0: "sıfır", 11: "on bir", 100: "yüz", 1000: "bin", 12345: "on iki bin üç yüz kırk beş", 1250001: "bir milyon iki yüz elli bin bir", 1001000: "bir milyon bin", 21000: "yirmi bir bin"}
    df = spark.createDataFrame([(n, f"{n}") for n in pins], "n long, t string")
    assert {r["n"]: r["w"] for r in df.select("n", reading.number_in_words(F.col("t")).alias("w")).collect()} == pins
    assert one(spark, reading.numbers_in_words(F.col("t")), t="a12 b" + "9" * 16) == "aon iki b" + "9" * 16


def test_spoken_text(spark):
    assert one(spark, reading.spoken(F.col("t")), t="%5 ve $12, 7 km & 3€") == "yüzde beş ve on iki dolar, yedi kilometre ve üç avro"
    said, removed = reading.speakable(F.col("t"))
    row = spark.createDataFrame([("iyi ☃ gün ♪",)], "t string").select(said.alias("s"), removed.alias("n")).first()
    assert (row["s"], row["n"]) == ("iyi gün", 2)
    assert one(spark, reading.match_key(F.col("t")), t="Işık 3'e!") == "işik üçe"
    assert one(spark, reading.metric_text(F.col("t")), t="İstanbul’da  86 KİŞİ") == "istanbulda seksen altı kişi"
    assert one(spark, reading.sentences(F.col("t")), t=" Bir 3.5 iki. Üç?!  Dört… beş") == ["Bir 3.5 iki.", "Üç?!", "Dört…", "beş"]
    assert one(spark, reading.caption(F.col("t")), t="a &amp;lt; b&nbsp; c&#39;s") == "a &lt; b c's"


def test_word_distance(spark):
    d = expr.word_distance(expr.words(F.col("a")), expr.words(F.col("b")))
    assert one(spark, d, a="one two three four", b="one three four five") == 2
    assert one(spark, d, a="", b="x") == 1


def test_ngrams_and_tokens(spark):
    assert one(spark, expr.ngrams(expr.words(F.col("a")), 3), a="a b") == ["a b"]
    assert one(spark, expr.ngrams(expr.words(F.col("a")), 3), a=" ") == []
    assert one(spark, expr.byte_tokens(F.col("a")), a="é") == [1, 0xC3 + 4, 0xA9 + 4, 2]


def test_interval_union(spark):
    df = spark.createDataFrame([("a", 0, 100), ("a", 50, 150), ("a", 300, 400)], "k string, s int, e int")
    assert ranges.islands(df, "k", "s", "e").agg(F.sum(F.col("e") - F.col("s"))).first()[0] == 250


def test_jackknife(spark):
    rows = [("s", c, n, d) for c, n, d in (("x", 3.0, 4.0), ("x", 1.0, 4.0), ("y", 0.0, 8.0), ("z", 2.0, 4.0))]
    sums = intervals.cluster_sums(spark.createDataFrame(rows, "s string, c string, n double, d double"), ["s"], "c", F.col("n"), F.col("d"))
    out = intervals.leave_one_out(sums, ["s"]).collect()
    assert {r["c"]: r["leave"] for r in out} == {"x": 2 / 12, "y": 6 / 12, "z": 4 / 16}
    assert out[0]["estimate"] == 0.3
    assert abs(intervals.t_quantile(0.975, 10) - 2.228139) < 1e-4


def test_tukey(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (10, 11, 12, 13, 14, 15, 16, 40, 1)], "g string, v double")
    f = curate.fences(df, "g", "v").first()
    assert sorted(x for (_, x) in df.collect() if x < f["low"] or x > f["high"]) == [1.0, 40.0]


def test_partition_invariance(spark):
    df = spark.range(2000)
    few = curate.hash_sample(df.repartition(1), "id", 0.3).orderBy("id").collect()
    assert few == curate.hash_sample(df.repartition(16), "id", 0.3).orderBy("id").collect()


def table_edits(a, b):
    """The whole table; where paths tie a match or substitution comes first, then a deletion."""
    t = {(0, j): (j, 0, 0, j) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        t[i, 0] = (i, 0, i, 0)
        for j in range(1, len(b) + 1):
            d, u, w = t[i - 1, j - 1], t[i - 1, j], t[i, j - 1]
            wrong = a[i - 1] != b[j - 1]
            options = [(d[0] + wrong, d[1] + wrong, d[2], d[3]), (u[0] + 1, u[1], u[2] + 1, u[3]), (w[0] + 1, w[1], w[2], w[3] + 1)]
            t[i, j] = min(options, key=lambda x: x[0])
    return t[len(a), len(b)][1:]


def test_byte_tokens_of_long_text(spark):
    """Linear in a text: 400,000 bytes, every byte value that UTF-8 has, empty and null text."""
    text = "".join(map(chr, range(1, 0x800))) + "日本😀" + "aé" * 130_000
    want = [x + 4 for x in text.encode()]
    start = time.time()
    assert one(spark, expr.byte_tokens(F.col("a")), a=text) == [1, *want, 2]
    assert time.time() - start < 20
    assert one(spark, expr.byte_tokens(F.col("a")), a="") == [1, 2]


def test_word_edit_kinds(spark):
    r = random.Random(6)
    pairs = [([r.choice("abcd") for _ in range(r.randint(0, 9))], [r.choice("abcd") for _ in range(r.randint(0, 9))]) for _ in range(300)]
    pairs += [([], []), (None, ["a"]), (["a"], None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a array<string>, b array<string>")
    got = {x["i"]: tuple(x["e"]) for x in df.select("i", word_edits(F.col("a"), F.col("b")).alias("e")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == ((None, None, None) if a is None or b is None else table_edits(a, b))


def test_edit_kinds_of_many_pairs_at_once():
    """Pairs of unlike lengths together, in few whole-array steps: 3,000 pairs of about 60 words in far less than a millisecond each."""
    r = np.random.default_rng(2)
    pairs = [tuple(r.integers(0, 6, r.integers(0, 40)) for _ in "ab") for _ in range(150)]
    got = edit_kinds_of([a for a, _ in pairs], [b for _, b in pairs])
    assert [tuple(x) for x in got] == [tuple(table_edits(list(a), list(b))) for a, b in pairs]
    a, b = ([r.integers(0, 50, 60) for _ in range(3000)] for _ in "ab")
    start = time.process_time()
    edit_kinds_of(a, b)
    assert time.process_time() - start < 1.5


def test_distances_of_many_distinct_words(spark):
    """20,000 distinct words, 16 of them out of place."""
    a = [f"w{i}" for i in range(20_000)]
    b = [f"x{w}" if i % 1250 == 7 else w for i, w in enumerate(a)]
    assert edit_kinds(np.arange(20_000), np.where(np.arange(20_000) % 1250 == 7, -1, np.arange(20_000))) == (16, 0, 0)
    df = spark.createDataFrame([(a[:9000], b[:9000])], "a array<string>, b array<string>")
    assert df.select(expr.word_distance(F.col("a"), F.col("b"))).first()[0] == 8


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_exact_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    r = random.Random(9)
    rows = [(g, v) for g in (None, "a", "b") for v in [r.choice([r.gauss(0, 1), r.gauss(0, 1e-300), r.gauss(0, 1e200), 0.0, -0.0, 2.5]) for _ in range(200)]]
    rows += [("one", 4.0), ("none", None), ("a", float("nan"))]
    got = {x["g"]: x["q"] for x in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", (0.0, 0.05, 0.5, 0.9, 1.0)).collect()}
    assert set(got) == {None, "a", "b", "one"}
    for g, q in got.items():
        values = [v for h, v in rows if h == g and v is not None and v == v]
        assert np.allclose(q, np.quantile(values, (0.0, 0.05, 0.5, 0.9, 1.0)), rtol=1e-12)
    everything = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), (), "v", (0.5,)).first()
    assert np.isclose(everything["q"][0], np.nanmedian([v for _, v in rows if v is not None]))


def test_places(spark):
    r = random.Random(2)
    values = [r.randint(0, 10**6) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(7)
    got = {x["i"]: x["place"] for x in places(df, "v", "i").collect()}
    assert got == {i: p for p, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert places(df.limit(0), "v").count() == 0
