"""Small specifications: selection rules, name=value lists, split keys, MODULE:FUNCTION names."""

from __future__ import annotations

import importlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.expr import let

# Measures and whether more (1) or less (-1) of them is better; families of models.
DIRECTION = {"cer": -1, "wer": -1, "dnsmos": 1, "dnsmos_sig": 1, "dnsmos_bak": 1, "utmos": 1, "sim": 1, "clip": -1}
FAMILIES = ("whisper", "wavlm", "unispeech", "wav2vec2", "hubert", "ecapa", "titanet", "dnsmos", "utmos")


@dataclass(frozen=True)
class Selection:
    """Measures in order of priority, or with weights for their sum."""

    measures: tuple[str, ...]
    weights: tuple[float, ...] | None = None


def parse_selection(spec: str) -> Selection:
    """``cer,wer`` (in order) or ``cer:10,dnsmos:1`` (a weighted sum); an error for unknown, repeated, or half-weighted measures."""
    parts = [p.strip().partition(":") for p in spec.split(",") if p.strip()]
    names = tuple(p[0].strip().lower() for p in parts)
    if not names or len(set(names)) < len(names) or (unknown := set(names) - set(DIRECTION)):
        raise ValueError(f"empty, repeated or unknown measures in {spec!r}" + (f": {sorted(unknown)}" if names and len(set(names)) == len(names) else ""))
    given = [float(p[2]) for p in parts if p[2]]
    if len(given) not in (0, len(names)) or not all(map(math.isfinite, given)):
        raise ValueError("give a finite weight to each measure or to none")
    return Selection(names, tuple(given) or None)


def ranking(rule: Selection, tie: str) -> list[Column]:
    """Sort order, best first; ties keep the earlier row."""
    if rule.weights is None:
        return [*(F.col(m).desc() if DIRECTION[m] > 0 else F.col(m).asc() for m in rule.measures), F.col(tie).asc()]
    score = sum((F.col(m) * float(w * DIRECTION[m]) for m, w in zip(rule.measures, rule.weights, strict=True)), F.lit(0.0))
    return [F.rint(score * 1e9).desc(), F.col(tie).asc()]  # sums that differ by rounding alone are ties


def parse_pairs(spec: str) -> dict[str, str]:
    """``name=value,name=value``; an error for a name without value or given twice."""
    out: dict[str, str] = {}
    for part in filter(None, map(str.strip, spec.split(","))):
        name, found, value = part.partition("=")
        if not found or not name or name in out:
            raise ValueError(f"not a name=value of its own: {part!r}")
        out[name] = value
    return out


def model_family(name: str) -> str:
    return next((f for f in FAMILIES if f in name.lower()), name.lower())


def family_of(name: Column, families: tuple[str, ...] = FAMILIES) -> Column:
    low = F.lower(name)
    return F.coalesce(*(F.when(low.contains(f), F.lit(f)) for f in families), low)


def named_values(spec: Column, between: str = ",") -> Column:
    """The parts of ``name=value,name=value`` as (name, value, problem); a part without name or value sign, or a name given twice, has a problem instead of an error."""

    def of(part: Column) -> Column:
        at = F.locate("=", part)
        name = F.when(at > 0, F.trim(F.substring(part, F.lit(1), at - 1)))
        return F.struct(name.alias("name"), F.when(at > 0, F.substring(part, at + 1, F.length(part))).alias("value"))

    def judged(found: Column) -> Column:
        again = lambda x: F.size(F.filter(found, lambda y: y["name"] == x["name"])) > 1
        problem = lambda x: F.when(F.coalesce(x["name"], F.lit("")) == "", "no name").when(again(x), "repeated")
        return F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), problem(x).alias("problem")))

    parts = F.filter(F.split(spec, between), lambda p: F.trim(p) != "")
    return let(F.transform(parts, of), judged)


def split_key(label: Column, pattern: str) -> Column:
    """The group ``key``, else the first group, else the whole match; an error where nothing matches or the key is empty."""
    regex = re.compile(pattern.replace("(?<key>", "(?P<key>"))
    at = regex.groupindex.get("key", 1 if regex.groups else 0)
    found = F.regexp_extract(label, regex.pattern.replace("(?P<key>", "(?<key>"), at)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no split key in "), label)).cast("string")).otherwise(found)


def load(name: str) -> Callable:
    """The function of ``module:function``."""
    module, colon, function = name.partition(":")
    if not colon or not module or not function:
        raise ValueError(f"expected MODULE:FUNCTION, not {name!r}")
    found = getattr(importlib.import_module(module), function, None)
    if not callable(found):
        raise ValueError(f"{module} has no function {function}")
    return found
