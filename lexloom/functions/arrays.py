"""Columns over arrays of samples, frames and tokens, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.expr import let


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def groups(a: Column, size: int, use) -> Column:
    """``use`` of each run of ``size`` elements; what is left over at the end does not count."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(a) / size).cast("int"), F.lit(1)) - 1), lambda i: use(F.slice(a, i * size + 1, F.lit(size))))


def frame_levels(samples: Column, size: int) -> Column:
    """RMS level of each frame in decibels of full scale."""
    return let(doubles(samples), lambda a: groups(a, size, lambda f: 20 * F.log10(F.sqrt(total(F.transform(f, lambda x: x * x)) / F.size(f)) + 1e-9)))


def loud_threshold(levels: Column, below_peak: float = 40.0, floor: float = -60.0) -> Column:
    return F.greatest(F.array_max(levels) - below_peak, F.lit(floor))


def trim_bounds(samples: Column, size: int, before: int, after: int, below_peak: float = 40.0, floor: float = -60.0) -> Column:
    """start and end sample of what is loud, with margins; the whole where nothing is."""

    def of(levels: Column) -> Column:
        def within(limit: Column) -> Column:
            loud = F.transform(levels, lambda x: x > limit)
            first = F.array_position(loud, F.lit(True))
            last = F.size(loud) + 1 - F.array_position(F.reverse(loud), F.lit(True))
            start = F.when(first > 0, F.greatest((first - 1) * size - before, F.lit(0))).otherwise(0)
            end = F.when(first > 0, F.least(last * size + after, F.size(samples))).otherwise(F.size(samples))
            return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))

        return let(loud_threshold(levels, below_peak, floor), within)

    return let(frame_levels(samples, size), of)


def pooled(features: Column, ratio: int, frames: Column, tolerance: int = 4) -> Column:
    """Means of ``ratio`` neighbours, one for each frame; a few missing at the end repeat the last one, a larger mismatch is an error."""
    needed = frames * ratio
    off = F.abs(F.size(features) - needed) > F.greatest(F.lit(tolerance), 0.02 * needed)
    filled = F.slice(F.concat(features, F.array_repeat(F.element_at(features, -1), F.greatest(needed - F.size(features), F.lit(0)))), 1, needed)
    return F.when(off, F.raise_error(F.lit("frames do not match the rate")).cast("array<double>")).otherwise(groups(doubles(filled), ratio, lambda f: total(f) / F.size(f)))


def quality_feature(score: Column) -> Column:
    """(x - 3) / 0.5, NaN and NULL as 0."""
    return F.coalesce(F.nanvl((score - 3.0) / 0.5, F.lit(0.0)), F.lit(0.0))


def tempo_key(factor: Column) -> Column:
    """A factor (1.25) or per mille (1250) as whole per mille, ties to even; NULL beyond half and double speed."""
    key = F.when(factor < 10, F.bround(factor * 1000)).otherwise(F.bround(factor)).cast("int")
    return F.when(key.between(500, 2000), key)


def padded_cost(n: Column, multiple: int) -> Column:
    return (F.floor((n + multiple - 1) / multiple) * multiple).cast("long")


def quiet_cut(frames: Column, cut: Column, silence: float, window: int) -> Column:
    """The cut moved behind the frame nearest to silence within the window; ties go to the frame nearest the cut."""
    low, high = F.greatest(cut - 1 - window, F.lit(0)), F.least(cut - 1 + window, F.size(frames) - 2)
    best = F.array_min(F.transform(F.sequence(low, high), lambda i: F.struct(F.pow(F.get(frames, i).cast("double") - silence, F.lit(2.0)).alias("d"), F.abs(i - cut + 1).alias("far"), i.alias("i"))))
    return F.when((cut >= 1) & (low <= high), best["i"] + 1).otherwise(cut)


def padded(a: Column, width: Column, fill) -> Column:
    return F.concat(a, F.array_repeat(fill, F.greatest(width - F.size(a), F.lit(0))))


def valid_mask(n: Column, width: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.greatest(width - n, F.lit(0))))


def mask_violation(valid: Column, reference: Column) -> Column:
    """The first broken rule of a row's masks, or NULL."""
    pairs = F.arrays_zip(valid.alias("v"), reference.alias("r"))
    outside = F.exists(pairs, lambda p: p["r"] & ~p["v"])
    gap = F.array_position(F.slice(valid, F.greatest(F.array_position(valid, F.lit(False)), F.lit(1)).cast("int"), F.size(valid)), F.lit(True)) > 0
    gap = gap & (F.array_position(valid, F.lit(False)) > 0)
    none = ~F.exists(pairs, lambda p: p["v"] & ~p["r"])
    return F.when(outside, "reference outside valid").when(gap, "valid is no prefix").when(none, "no target")


def resized(a: Column, n: Column, fill: Column) -> Column:
    """Cut or padded at its end to n elements."""
    return F.slice(F.concat(a, F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0)))), 1, n)


def repeated_span(a: Column, at: Column, source: Column, n: Column) -> Column:
    """The n elements from ``at`` overwritten by those from ``source`` (both from 0)."""
    return F.concat(F.slice(a, 1, at), F.slice(a, source + 1, n), F.slice(a, at + n + 1, F.size(a)))


def skipped_span(a: Column, at: Column, n: Column, fill: Column) -> Column:
    """The n elements from ``at`` taken out, the rest moved forward, the tail filled."""
    return F.concat(F.slice(a, 1, at), F.slice(a, at + n + 1, F.size(a)), F.array_repeat(fill, n))


def projected(a: Column, mean: list[float], components: list[list[float]]) -> Column:
    """(a - mean) by each component."""
    centred = F.zip_with(a, F.array(*map(F.lit, mean)), lambda x, m: x.cast("double") - m)
    return let(centred, lambda c: F.array(*(F.aggregate(F.zip_with(c, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for w in components)))


def joined_ids(parts: Column, bos: int = 1, space: int = 36, eos: int = 3) -> Column:
    """Cached ids of several utterances (each with its begin and end) as one, a space between them."""
    bodies = F.transform(parts, lambda p: F.concat(F.slice(p, 2, F.size(p) - 2), F.array(F.lit(space))))
    flat = F.flatten(bodies)
    return F.concat(F.array(F.lit(bos)), F.slice(flat, 1, F.size(flat) - 1), F.array(F.lit(eos)))


def assembled(reference: Column, target: Column, layout: str = "segments", bos: int = 1, sep: int = 2, eos: int = 3, space: int = 36) -> Column:
    """tokens and segments of a reference and a target (cached ids): kept apart by a mark, or joined into one stream."""
    ref, tgt = F.slice(reference, 2, F.size(reference) - 2), F.slice(target, 2, F.size(target) - 2)
    if layout == "joined":
        tokens = F.concat(F.array(F.lit(bos)), ref, F.array(F.lit(space)), tgt, F.array(F.lit(eos)))
        return let(tokens, lambda t: F.struct(t.alias("tokens"), F.array_repeat(F.lit(1), F.size(t)).alias("segments")))
    tokens = F.concat(F.array(F.lit(bos)), ref, F.array(F.lit(sep)), tgt, F.array(F.lit(eos)))
    return F.struct(tokens.alias("tokens"), F.concat(F.array_repeat(F.lit(0), F.size(ref) + 2), F.array_repeat(F.lit(1), F.size(tgt) + 1)).alias("segments"))


#: Labels of the alignment alphabet, blank 0, blank space 1; circumflexes count as their vowels.
ALPHABET = " abcdefghijklmnopqrstuvwxyzçğıöşü"


def alignment_text(text: Column) -> Column:
    """Turkish lower case, letters and single blanks; apostrophes vanish."""
    low = F.lower(F.translate(text, "İI", "iı"))
    low = F.translate(F.regexp_replace(low, "['’]", ""), "âîû", "aiu")
    return F.trim(F.regexp_replace(F.regexp_replace(low, f"[^{ALPHABET[1:]}]", " "), " +", " "))


def alignment_labels(text: Column) -> Column:
    book = F.split(F.lit(ALPHABET), "")
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, ""), lambda c: F.array_position(book, c)))


def without_word(words: Column, i: Column) -> Column:
    """A transcript with one word skipped (i from 0)."""
    return F.concat(F.slice(words, 1, i), F.slice(words, i + 2, F.size(words)))


def word_twice(words: Column, i: Column) -> Column:
    return F.concat(F.slice(words, 1, i + 1), F.slice(words, i + 1, F.size(words)))
