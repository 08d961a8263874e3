"""Event-time windows over streams: tumbling, sliding and session windows behind a watermark (an extension; the corpora's own streams have none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, late: str, width: str, by: list[str | Column], *aggregates: Column) -> DataFrame:
    return sliding(events, time, late, width, width, by, *aggregates)


def sliding(events: DataFrame, time: str, late: str, width: str, step: str, by: list[str | Column], *aggregates: Column) -> DataFrame:
    """start, end, ``by`` and aggregates of every window; rows later than the watermark are dropped, and state goes with it."""
    w = F.window(time, width, step)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in out.columns if c != "w"))


def sessions(events: DataFrame, time: str, late: str, gap: str, by: list[str | Column], *aggregates: Column) -> DataFrame:
    """Windows that end when nothing came for ``gap``."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in out.columns if c != "w"))
