"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a key and in ``weight`` how many rows the key has.

    Keys above an eighth of a task's mean share are at most eight a task: they are broadcast, and their rows stay where they are. The
    others are joined as usual, so no task gets a group. ``rows`` is counted and read twice: pass a written table.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = max(1, rows.count() // (8 * tasks))
    hot = F.broadcast(side.filter(F.col(weight) > bound))
    rest = rows.join(hot.select(*keys), list(keys), "left_anti")
    return rows.join(hot, list(keys)).unionByName(rest.join(side.filter(F.col(weight) <= bound), list(keys), how))
