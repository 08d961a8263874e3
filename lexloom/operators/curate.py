"""Row rules, sampling, fences, caps, first-wins dedup, contamination and drop lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.expr import finite, hash01, ngrams, words
from lexloom.operators.order import places
from lexloom.operators.quantiles import exact_quantiles
from lexloom.session import cut


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that fails (its condition is true), NULL for rows that pass all."""
    return F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in rules))


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """A sample that depends on the key alone, not on order or partitions."""
    return df.filter(hash01(F.lit(str(seed)), F.col(key).cast("string")) < fraction)


def first_wins(df: DataFrame, key: Sequence[str | Column], order: str) -> DataFrame:
    """The first row of each key in arrival order, by a min-by aggregate: partial sums keep a hot key cheap."""
    named = [k if isinstance(k, Column) else F.col(k) for k in key]
    keys = [k.alias(f"_k{i}") for i, k in enumerate(named)]
    row = F.struct(F.col(order).alias("_order"), F.struct(*df.columns).alias("_row"))
    return df.groupBy(*keys).agg(F.min(row).alias("_first")).select("_first._row.*")


def capped(df: DataFrame, group: str, order: Sequence[Column | str], limit: int) -> DataFrame:
    """At most ``limit`` rows of a group, in order. Spark keeps only the best ``limit`` of a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def quota(df: DataFrame, group: str, order: Sequence[Column | str], each: int, total: int) -> DataFrame:
    """At most ``total`` rows: the best ``each`` of every group first, then, where groups have fewer, the best of what is left of the others."""
    best = capped(df, group, order, total)  # no group gives more
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return best.withColumn("_over", (rank > each).cast("int")).orderBy("_over", *order).limit(total).drop("_over")


def fences(df: DataFrame, group: str, value: str, k: float = 1.5) -> DataFrame:
    """Tukey fences by group, with exact linear percentiles."""
    q = exact_quantiles(df, group, value, (0.25, 0.75))
    spread = (F.col("q")[1] - F.col("q")[0]) * k
    return q.select(group, (F.col("q")[0] - spread).alias("low"), (F.col("q")[1] + spread).alias("high"))


BROADCAST_GRAMS = 1 << 18


def contaminated(docs: DataFrame, held_out: DataFrame, near: float = 0.8, n: int = 3, min_words: int = 5) -> DataFrame:
    """key, reason: exact, contains or near. Both sides have (key, norm) with normalised text.

    One pass over ``docs``: the text's n-grams leave the row one by one and meet the held-out sentences' n-grams, which are broadcast
    if there are at most ``BROADCAST_GRAMS`` of them (they are counted), so nothing of a document is shuffled but what it shares
    with a sentence. All three reasons come from these meetings: a held-out sentence is contained only where its first n-gram is. A larger held-out
    side is joined by rare grams (``_by_rare_grams``), with the same rows.
    """
    right = held_out.select(F.col("norm").alias("sentence")).distinct().filter("sentence != ''")
    right = right.select("sentence", ngrams(words(F.col("sentence")), n).alias("other"), F.size(words(F.col("sentence"))).alias("n_words"))
    index = cut(right.select("sentence", "n_words", F.size("other").alias("other_size"), F.posexplode("other").alias("place", "gram")))
    if index.count() > BROADCAST_GRAMS:
        return _by_rare_grams(docs, cut(right), near, n, min_words)
    index = F.broadcast(index)
    # explode_outer: a plain explode makes Spark compute the n-grams once more, as a filter in front
    left = docs.select("key", "norm", ngrams(words(F.col("norm")), n).alias("grams")).select("key", "norm", F.size("grams").alias("size"), F.explode_outer("grams").alias("gram"))
    padded = F.concat(F.lit(" "), "norm", F.lit(" "))
    found = left.join(index, "gram").select(
        "key", "sentence", F.least("size", "other_size").alias("smaller"),
        F.when(F.col("place") == 0, F.col("norm") == F.col("sentence")).alias("same"),
        F.when((F.col("place") == 0) & (F.col("n_words") >= min_words), padded.contains(F.concat(F.lit(" "), "sentence", F.lit(" ")))).alias("holds"),
    )
    pairs = found.groupBy("key", "sentence").agg(F.count("*").alias("both"), F.first("smaller").alias("smaller"), F.max("same").alias("same"), F.max("holds").alias("holds"))
    return _reasons(pairs, near)


def _reasons(pairs: DataFrame, near: float) -> DataFrame:
    """The strongest reason of each key, from pairs of documents and sentences (both, smaller, same, holds)."""
    close = (F.col("smaller") >= 2) & (F.col("both") / F.col("smaller") >= near)
    rule = F.when(F.col("same"), 1).when(F.col("holds"), 2).when(close, 3)
    best = pairs.select("key", rule.alias("rule")).filter("rule is not null").groupBy("key").agg(F.min("rule").alias("rule"))
    return best.select("key", F.element_at(F.array(F.lit("exact"), F.lit("contains"), F.lit("near")), F.col("rule")).alias("reason"))


def _prefix(size: Column, near: float) -> Column:
    """How many grams of a set are enough: who shares ``near`` of the set shares one of any so many."""
    return size - F.ceil(size * near - 1e-9) + 1


def _by_rare_grams(docs: DataFrame, right: DataFrame, near: float, n: int, min_words: int) -> DataFrame:
    """``contaminated`` for a held-out side of any size: candidates by prefixes of grams, as ids and hashes, then a look at their texts.

    Where the sentence is the smaller side, a document that matches has one of the sentence's few rarest grams (rare on the held-out side, so
    common phrases are met by no one); where the document is smaller, one of a few grams of its own is in the sentence. Only keys, sentence numbers and
    8-byte hashes are shuffled; a text is joined back once for each candidate. Equal hashes only make candidates: grams themselves are compared after.
    """
    sentences = cut(places(right, "sentence", name="sid"))
    grams = cut(sentences.select("sid", F.size("other").alias("other_size"), F.explode("other").alias("gram")).select("sid", "other_size", F.xxhash64("gram").alias("g")))
    often = grams.groupBy("g").agg(F.count("*").alias("f"))
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("f", "g"))  # one sentence's grams
    rare = grams.join(often, "g").withColumn("k", rank).filter(F.col("k") <= _prefix(F.col("other_size"), near)).select("sid", "g")
    left = docs.select("key", F.transform(ngrams(words(F.col("norm")), n), lambda x: F.xxhash64(x)).alias("gs"))
    by_sentence = left.select("key", F.explode("gs").alias("g")).join(rare, "g").select("key", "sid")
    own = left.select("key", F.size("gs").alias("size"), F.explode(F.slice(F.array_sort("gs"), 1, F.greatest(_prefix(F.size("gs"), near), F.lit(0)).cast("int"))).alias("g"))
    by_document = own.join(grams, "g").filter("size < other_size").select("key", "sid")
    candidates = cut(by_sentence.union(by_document).distinct())
    met = candidates.join(docs.select("key", "norm"), "key").join(sentences, "sid").withColumn("grams", ngrams(words(F.col("norm")), n))
    padded = F.concat(F.lit(" "), "norm", F.lit(" "))
    pairs = met.select(
        "key", F.size(F.array_intersect("grams", "other")).alias("both"), F.least(F.size("grams"), F.size("other")).alias("smaller"),
        (F.col("norm") == F.col("sentence")).alias("same"),
        F.when(F.col("n_words") >= min_words, padded.contains(F.concat(F.lit(" "), "sentence", F.lit(" ")))).alias("holds"),
    )
    return _reasons(pairs, near)


def drop_list(df: DataFrame, scores: dict[str, Column], unscored: Sequence[str]) -> DataFrame:
    """Rows with ``reason``; a rule counts only if its score exists in some row at all (one-row counts, broadcast)."""
    needed = sorted({c for c in unscored})
    present = df.agg(*(F.count(finite(F.col(c).cast("double"))).alias(f"_n_{c}") for c in needed))
    rows = df.join(F.broadcast(present))
    missing = F.lit(False)
    for c in needed:
        missing = missing | ((F.col(f"_n_{c}") > 0) & finite(F.col(c).cast("double")).isNull())
    reason = first_reason(*scores.items(), ("unscored", missing))
    return rows.withColumn("reason", reason).drop(*(f"_n_{c}" for c in needed))
