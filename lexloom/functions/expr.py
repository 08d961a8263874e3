"""Column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda that named the expression itself would compute it for each element."""
    return F.transform(F.array(value), use)[0]


def hash01(*parts: Column | str) -> Column:
    """Uniform number in [0, 1): the first eight bytes of SHA-256 over the parts joined by ":"."""
    text = F.concat_ws(":", *(F.col(p) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def split_of(key: Column, seed: int = 0, test: float = 0.01, val: float = 0.02) -> Column:
    """test, val or train by a key's hash."""
    u = hash01(F.lit(str(seed)), key.cast("string"))
    return F.when(u < test, "test").when(u < val, "val").otherwise("train")


def finite(c: Column) -> Column:
    """NULL for NaN and infinities: avg() would carry them on."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def tr_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "İI", "iı"))


def tr_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def words(c: Column) -> Column:
    """Words between white space; an empty array for blank text."""
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams joined by spaces; fewer than n words give the whole sequence, none an empty array."""

    def of(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(grams)).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, of)


def ascii_metric_text(c: Column) -> Column:
    """Lower-case ASCII letters, digits and apostrophes, everything else a space."""
    low = F.regexp_replace(F.lower(c), "’", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9'\s]", " "), r"\s+", " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A vector over its L2 norm; an error for the zero vector."""
    norm = F.sqrt(dot(a, a))
    return let(F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("zero vector")).cast("double")), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two word arrays: each distinct word of the pair becomes one character above the basic plane (a million of them)."""

    def of(book: Column) -> Column:
        def coded(x: Column) -> Column:
            return F.array_join(F.transform(x, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(book, w).cast("int") + 0xFFFF), 8, "0")), "UTF-32")), "")

        return F.levenshtein(coded(a), coded(b))

    return let(F.array_distinct(F.concat(a, b)), of)


def length_bucket(n: Column) -> Column:
    return F.when(n <= 5, "1-5").when(n <= 9, "6-9").otherwise("10+")


# The patterns of units and pauses define the result.
def text_units(c: Column) -> dict[str, Column]:
    """Bytes, characters, vowels, words, comma-like and stop-like punctuation of a text."""
    return {
        "n_bytes": F.octet_length(c),
        "n_code_points": F.length(c),
        "syllables": F.regexp_count(c, F.lit("[aeıioöuüâîû]")),
        "n_words": F.size(words(c)),
        "commas": F.regexp_count(c, F.lit("[,;:-]")),
        "stops": F.regexp_count(c, F.lit("[.!?]+")),
    }


def pause_seconds(c: Column, comma: float = 0.15, stop: float = 0.3) -> Column:
    """Pause that the punctuation inside a text asks for; what ends it adds nothing."""
    body = F.regexp_replace(c, r"[\s.!?,;:…\"'»”’)\]-]+$", "")
    return F.regexp_count(body, F.lit(r"[,;:]|\s-\s")) * comma + F.regexp_count(body, F.lit("[.!?…]+")) * stop


def byte_tokens(c: Column, shift: int = 4, bos: int = 1, eos: int = 2) -> Column:
    """UTF-8 bytes shifted by the special ids, between begin and end. Read as Latin-1, each byte is one character, so that they are split in one pass."""
    def of(h: Column) -> Column:
        body = F.transform(F.split(h, ""), lambda x: F.ascii(x) + shift)
        return F.concat(F.array(F.lit(bos)), F.when(F.length(h) > 0, body).otherwise(F.array().cast("array<int>")), F.array(F.lit(eos)))

    return let(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), of)
