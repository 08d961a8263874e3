"""Quality rules, line first, in DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines go; a document that
loses more than half of its words with them is rejected. Base figures of the whole text come beside it.

Words are ``[^\\x20\\x09-\\x0D]+``. Base: ``word_chars`` (code points in words), ``n_symbols`` (characters of
``#*$%&|<>``), ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_repeat_words`` (words that
lie in a three-word window found twice or more in the text, the first find included). ``base_failed``:
fewer than 50 words, or more than half of them repeated.

Everything is computed inside the row: no shuffle, no task that holds more than a document.
Edge cases: null and empty texts have no words, fail the base and give a null or empty ``clean_text``;
nulls elsewhere, repeated rows and extra columns do not matter (a column with the name of a figure gives way to it, any
other keeps its values); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Fixed values of the rules: endings of a sentence and what may close behind them, menu entries, legal and consent phrases.
STOPS, CLOSERS = ".!?:;…。！？", "'\"»”’)]"
NAVIGATION = r"(?i)^\W*(home|menu|search|log ?in|log ?out|sign ?(in|up)|register|contact( us)?|about( us)?|next|previous|back( to top)?|read more|share|print|sitemap|skip to (main )?content)\W*$"
BOILERPLATE = r"(?i)(all rights reserved|licensed under|released under the|copyright ©|\(c\) copyright|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|subscribe to our|enable javascript|lorem ipsum)"


def spaced(c: Column) -> Column:
    """Every blank a space."""
    return F.translate(c, BLANKS, " " * len(BLANKS))


def words(c: Column) -> Column:
    """The words of a text. No regular expression: several character classes in one plan make each of them slow."""
    return F.filter(F.split(spaced(c), " "), lambda w: w != "")


def n_symbols(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, SYMBOLS, ""))


def line_passes(line: Column) -> Column:
    """Whether one line survives: it ends as a sentence, is no menu or table row, no boilerplate, no symbol noise."""
    n, noise, shouts = F.size(words(line)), n_symbols(line), F.size(F.split(line, "!!")) - 1
    ends = F.instr(F.lit(STOPS), F.substring(F.rtrim(F.rtrim(spaced(line)), F.lit(CLOSERS)), -1, 1)) > 0
    return (F.trim(spaced(line)) != "") & ends & ~line.rlike(NAVIGATION) & ~line.rlike(BOILERPLATE) & ((noise == 0) | (10 * noise <= 2 * n)) & (~line.contains("!!") | (10 * shouts <= 3 * n))


SCRATCH = ("_words", "_lines", "_windows", "_full", "_good", "_order", "_twice")


def _unused(names: list[str]) -> str:
    """A beginning that no name has."""
    mark = "kept_"
    while any(n.startswith(mark) for n in names):
        mark += "_"
    return mark


def quality(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_lost_percent: int = 50) -> DataFrame:
    """``docs`` with the figures, ``base_failed``, ``lost_words``, ``clean_text`` and ``kept``; the text is read, all columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    clash = {c: f"{mark}{c}" for c in docs.columns if c in SCRATCH for mark in [_unused(docs.columns)]}
    docs = docs.withColumnsRenamed(clash)
    step = docs.withColumn("_words", words(text)).withColumn("_lines", F.split(text, "\n"))
    n = F.size("_words")
    at = lambda i: F.get("_words", i)
    window = lambda i, *seed: F.xxhash64(*seed, at(i), at(i + 1), at(i + 2))
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i))
    full = F.filter("_lines", lambda x: F.trim(spaced(x)) != "")
    step = step.withColumn("_windows", F.when(n >= 3, windows)).withColumn("_full", full).withColumn("_good", F.filter("_lines", line_passes))
    # a text whose windows differ by one hash has none twice; in the others two hashes, 128 bits, tell windows apart
    order = F.sort_array(F.transform("_windows", lambda h, i: F.struct(F.struct(h, window(i, F.lit(1))).alias("t"), i.alias("i"))))
    step = step.withColumn("_order", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), order))
    near = lambda k: F.get("_order", k)["t"]
    twice = F.transform("_order", lambda x, k: F.when((x["t"] == near(k - 1)) | (x["t"] == near(k + 1)), x["i"]))
    step = step.withColumn("_twice", F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    gaps = F.transform("_twice", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_twice", k + 1) - p, F.lit(3))))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, b: a + b), F.lit(0))
    clean = F.array_join("_good", "\n")
    kept_words = F.size(words(F.col("clean_text")))
    out = step.withColumn("clean_text", F.when(F.col("text").isNotNull(), clean)).withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": n_symbols(text).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": repeated.cast("long"),
        }
    )
    out = out.withColumn("lost_words", F.col("n_words") - F.coalesce(kept_words, F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= max_lost_percent * F.col("n_words")))
    return out.drop(*SCRATCH).withColumnsRenamed({new: old for old, new in clash.items()})


def passing(docs: DataFrame, **limits: int) -> DataFrame:
    """The rows of ``quality`` that are kept. The row number keeps Spark from moving the filter below the steps, where it
    would compute every word list again inside every lambda."""
    row = f"{_unused(docs.columns)}row"
    out = quality(docs, **limits).withColumn(row, F.monotonically_increasing_id())
    return out.filter(F.col("kept") & (F.col(row) >= 0)).drop(row)
