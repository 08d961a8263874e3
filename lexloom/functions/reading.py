"""Text as it is read aloud and compared, in column functions: numbers in words, units and signs, metric text, keys, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.expr import let, tr_lower

# Turkish number words, unit and sign readings, the character names of hypertext.
ONES = ("", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz")
TENS = ("", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan")
SCALES = ("trilyon", "milyar", "milyon", "bin", "")
UNITS = (("km", "kilometre"), ("cm", "santimetre"), ("mm", "milimetre"), ("kg", "kilogram"), ("mg", "miligram"), ("ml", "mililitre"), ("GB", "gigabayt"), ("MB", "megabayt"), ("kWh", "kilovat saat"), ("Hz", "hertz"))
SIGNS = (("₺", "lira"), ("$", "dolar"), ("€", "avro"), ("£", "sterlin"))
SYMBOLS = (("&", "ve"), ("+", "artı"), ("=", "eşittir"), ("°", "derece"), ("№", "numara"))
NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
DIGITS = 3 * len(SCALES)
BLANKS = r"[\x09-\x0d\x20\x{A0}]+"


def _digit(words: tuple[str, ...], digit: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), digit.cast("int") + 1)


def number_in_words(digits: Column) -> Column:
    """A run of at most ``DIGITS`` digits in words. "bir" is not said before "yüz" and, alone, before "bin"."""

    def of(padded: Column) -> Column:
        parts = []
        for i, scale in enumerate(SCALES):
            hundred, ten, one = (F.substring(padded, 3 * i + k, 1) for k in (1, 2, 3))
            group = F.substring(padded, 3 * i + 1, 3)
            said = [F.when(hundred > "1", _digit(ONES, hundred)), F.when(hundred > "0", "yüz"), _digit(TENS, ten), _digit(ONES, one) if scale != "bin" else F.when(group != "001", _digit(ONES, one))]
            parts += [*said, F.when(group != "000", scale)]
        return F.coalesce(F.nullif(F.array_join(F.filter(F.array(*parts), lambda w: w.isNotNull() & (w != "")), " "), F.lit("")), F.lit("sıfır"))

    return let(F.lpad(digits, DIGITS, "0"), of)


def numbers_in_words(text: Column) -> Column:
    """``text`` with its runs of digits in words; longer runs than ``DIGITS`` stay."""
    pieces = F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(rf"^[0-9]{{1,{DIGITS}}}$"), number_in_words(p)).otherwise(p)), "")


def spaced(text: Column) -> Column:
    """Blanks of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def spoken(text: Column) -> Column:
    """Percentages, units behind numbers, money signs on either side of them and symbols by their names, then numbers in words."""
    out = F.regexp_replace(text, r"%\s?([0-9]+)", "yüzde $1")
    for sign, name in SIGNS:
        out = F.regexp_replace(out, rf"\Q{sign}\E ?([0-9]+)", f"$1 {name}")
        out = F.regexp_replace(out, rf"([0-9]) ?\Q{sign}\E", f"$1 {name}")
    for unit, name in UNITS:
        out = F.regexp_replace(out, rf"([0-9]) ?{unit}\b", f"$1 {name}")
    for symbol, name in SYMBOLS:
        out = F.replace(out, F.lit(symbol), F.lit(f" {name} "))
    return spaced(numbers_in_words(out))


#: What a voice can read: letters, digits, blanks and plain punctuation.
SAYABLE = r"""[^\p{L}\p{N}\x09-\x0d\x20.,!?;:'"()-]"""


def speakable(text: Column) -> tuple[Column, Column]:
    """What is left of the spoken form once characters that no voice can read are blanks, and how many those were."""
    said = spoken(text)
    return spaced(F.regexp_replace(said, SAYABLE, " ")), F.regexp_count(said, F.lit(SAYABLE))


def metric_text(text: Column) -> Column:
    """Lower case, numbers in words, no apostrophes, letters and digits only."""
    bare = F.regexp_replace(tr_lower(text), "['’]", "")
    return F.trim(F.regexp_replace(numbers_in_words(bare), r"[^\p{L}\p{N}]+", " "))


def match_key(text: Column) -> Column:
    """Metric text with the dotless i and circumflexes folded."""
    return F.translate(metric_text(text), "ıâîû", "iaiu")


def caption(text: Column) -> Column:
    """Text with the named characters of hypertext and single blanks."""
    for name, character in NAMED:
        text = F.replace(text, F.lit(name), F.lit(character))
    return spaced(text)


def sentences(text: Column) -> Column:
    """Parts of a text that end with a full stop, mark or ellipsis before a blank, or with the text."""
    marked = F.regexp_replace(text, r"([.!?…]+)([\x09-\x0d\x20]+|\z)", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), spaced), lambda s: s != "")


def spectrum(x: Column, n: int) -> Column:
    """Power of the frequencies 1 .. n / 2 of ``n`` samples, by their definition."""
    tau = 6.283185307179586

    def power(k: Column) -> Column:
        def part(wave):
            return F.aggregate(F.transform(x, lambda v, i: v.cast("double") * wave(k * i * F.lit(tau / n))), F.lit(0.0), lambda s, v: s + v)

        return F.pow(part(F.cos), F.lit(2.0)) + F.pow(part(F.sin), F.lit(2.0))

    return F.transform(F.sequence(F.lit(1), F.lit(n // 2)), power)
