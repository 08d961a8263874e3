"""Functions of the user's inside a plan: named MODULE:FUNCTION, built once a worker, by batch or by group."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.specs import load


def mapped(name: str, kind: str) -> Callable[[Column], Column]:
    """A column function from ``module:function`` (value -> value); the module is imported on the workers, once each."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        function = load(name)
        for s in batches:
            yield s.map(lambda x: None if x is None else function(x))

    return run


def built(factory: str, kind: str, **settings) -> Callable[[Column], Column]:
    """A column function from ``module:factory``: the factory makes a model of its settings once a task, which is called with whole batches."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load(factory)(**settings)
        for s in batches:
            yield pd.Series(list(model(list(s))))

    return run


def embedded(df: DataFrame, factory: str, key: str, column: str, **settings) -> DataFrame:
    """key, embedding: rows go through a model built once a task, a batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(factory)(**settings)
        for f in frames:
            yield pd.DataFrame({key: f[key], "embedding": [list(map(float, v)) for v in model(list(f[column]))]})

    return df.select(key, column).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


def group_terms(df: DataFrame, group: str, key: str, terms: dict[str, tuple[str, float, float]], columns: Sequence[str]) -> DataFrame:
    """group, key, one column a term: ``module:function`` gives a score for each row of a group, times its sign, no less than its floor."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        out = pdf[[group, key]].copy()
        for name, (function, sign, floor) in terms.items():
            out[name] = [max(floor, sign * float(x)) for x in load(function)(pdf)]
        return out

    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, " + ", ".join(f"{t} double" for t in terms)
    return df.select(group, key, *columns).groupBy(group).applyInPandas(run, schema)


def selected(df: DataFrame, group: str, key: str, chooser: str, columns: Sequence[str]) -> DataFrame:
    """group, key of the candidate that ``module:function`` picks by its place in each group (ordered by key)."""
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows: a group is whole once another one begins, so the last one of a frame waits for the next frame."""
        choose, rest = load(chooser), None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            at = frame[group].to_numpy()
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
            if len(starts):
                yield picked(frame, [*starts], choose)
                rest = frame.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield picked(rest, [0, len(rest)], choose)

    def picked(frame: pd.DataFrame, cuts: list[int], choose) -> pd.DataFrame:
        rows = [a + int(choose(frame.iloc[a:b].reset_index(drop=True))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return frame.iloc[rows][[group, key]]

    rows = df.select(group, key, *columns).repartition(group).sortWithinPartitions(group, key)
    return rows.mapInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}")


@F.udtf(returnType="i int, chunk string, pause string")
class SplitSentences:
    """One row for each sentence of a text, for lateral joins in SQL: ``FROM t, LATERAL split_sentences(t.text)``."""

    def eval(self, text: str):
        parts = [p for p in re.split(r"(?<=[.!?…])\s+", (text or "").strip()) if p]
        for i, part in enumerate(parts):
            yield i, part, "sentence" if part[-1] in ".!?…" else "none"


def register(spark) -> None:
    spark.udtf.register("split_sentences", SplitSentences)
