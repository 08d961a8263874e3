"""How long a text takes to say: rules by unit, clamps, articulation, and a log-linear predictor fitted by ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.expr import pause_seconds, text_units

FRAME_RATE = 25.0
SLOW, FAST = 13.0, 17.0
FEATURES = ("bias", "log_syllables", "log_words", "log_bytes", "commas_per_word", "stops_per_word", "log_prompt_frames_per_syllable", "log_prompt_frames_per_byte", "log_prompt_frames")


def rule_frames(frames: Column, reference: Column, text: Column, unit: str = "n_bytes") -> Column:
    """The prompt's frames a unit, times the text's units."""
    a, b = text_units(reference)[unit], text_units(text)[unit]
    return frames / F.greatest(a, F.lit(1)) * F.greatest(b, F.lit(1))


def speaking_rate(frames: Column, reference: Column) -> Column:
    return F.length(reference) / F.greatest(frames / FRAME_RATE, F.lit(1e-3))


def clamp_scale(frames: Column, reference: Column, threshold: float = 17.0, target: float = 16.0, most: float = 1.2) -> Column:
    """A factor from 1 that slows prompts above a rate."""
    rate = speaking_rate(frames, reference)
    return F.when(rate <= threshold, 1.0).otherwise(F.least(rate / target, F.lit(most)))


def auto_mode(frames: Column, reference: Column) -> Column:
    rate = speaking_rate(frames, reference)
    return F.when(rate < SLOW, "predictor").when(rate > FAST, "clamp").otherwise("rule")


def articulation_seconds(speech: Column, reference: Column, text: Column, slowest: float = 3.0, fastest: float = 8.5, least: float = 0.5) -> Column:
    """Syllables over the prompt's rate (kept within bounds) plus the text's pauses; NULL where the prompt gives no rate."""
    own, wanted = text_units(reference)["syllables"], text_units(text)["syllables"]
    rate = F.least(F.greatest(own / speech, F.lit(slowest)), F.lit(fastest))
    return F.when((speech > 0) & (own > 0), F.greatest(F.greatest(wanted, F.lit(1)) / rate + pause_seconds(text), F.lit(least)))


def features(frames: Column, reference: Column, text: Column) -> list[Column]:
    """The predictor's nine features, in the order of FEATURES."""
    a, b = text_units(reference), text_units(text)
    one = lambda c: F.greatest(c, F.lit(1))
    return [
        F.lit(1.0), F.ln(one(b["syllables"])), F.ln(one(b["n_words"])), F.ln(one(b["n_bytes"])), b["commas"] / one(b["n_words"]), b["stops"] / one(b["n_words"]),
        F.ln(frames / one(a["syllables"])), F.ln(frames / one(a["n_bytes"])), F.ln(one(frames)),
    ]


def normal_equations(df: DataFrame, x: list[Column], y: Column) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and the number of rows: one row of sums, whatever the table's size."""
    k = len(x)
    rows = df.select(*(c.cast("double").alias(f"x{i}") for i, c in enumerate(x)), y.cast("double").alias("y")).dropna()
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    one = rows.agg(F.count("*").alias("n"), *sums, *(F.sum(F.col(f"x{i}") * F.col("y")).alias(f"t{i}") for i in range(k))).first()
    a = np.array([[one[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return a, np.array([one[f"t{i}"] or 0.0 for i in range(k)]), one["n"]


def ridge(df: DataFrame, x: list[Column], y: Column, strength: float = 1e-3) -> np.ndarray:
    """Weights that predict y from x; the first feature is the intercept and is not shrunk."""
    a, b, n = normal_equations(df, x, y)
    penalty = strength * n * np.eye(len(x))
    penalty[0, 0] = 0.0
    return np.linalg.solve(a + penalty, b)


def predicted_frames(weights: np.ndarray, x: list[Column]) -> Column:
    return F.exp(sum((c * float(w) for w, c in zip(weights, x, strict=True)), F.lit(0.0)))


def moments(df: DataFrame, vector: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and products of an array column: a matrix product a batch, then sums by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            column = batch.column(0).drop_null()
            x = np.column_stack([np.ones(len(column)), column.flatten().to_numpy().astype(np.float64).reshape(-1, width)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "v"])

    sums = df.select(vector).mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toPandas()
    whole = np.zeros((width + 1) ** 2)
    whole[sums["place"].to_numpy()] = sums["v"].to_numpy()
    whole = whole.reshape(width + 1, width + 1)
    return round(whole[0, 0]), whole[0, 1:], whole[1:, 1:]


def principal_components(df: DataFrame, vector: str, width: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (dim x width, largest loading positive) and explained shares, from sums and products of one pass."""
    n, sums, products = moments(df, vector, width)
    if n < 2 or not 1 <= dim <= width:
        raise ValueError("two rows at least, and no more components than dimensions")
    mean = sums / n
    values, vectors = np.linalg.eigh((products - n * np.outer(mean, mean)) / (n - 1))
    order = np.argsort(values)[::-1][:dim]
    parts = vectors[:, order].T
    parts *= np.where(parts[np.arange(dim), np.abs(parts).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return mean, parts, np.maximum(values[order], 0) / max(np.maximum(values, 0).sum(), 1e-12)
