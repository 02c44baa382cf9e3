"""Joins with a table that has one row for each key, however unevenly the keys are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with a thousandth of all rows or more are joined by broadcast; there are at most so many of them.
HOT_KEYS = 1000


def join_keys(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keys, which has one row for each value of ``key`` and in ``n`` how many of the rows have it; total:
    no less than the sum of n. Values that hold a thousandth of the total or more, HOT_KEYS at most, are broadcast, so
    none of them gathers in one task; the others meet in a shuffle."""
    hot, rest = keys.where(F.col("n") * HOT_KEYS >= total).drop("n"), keys.where(F.col("n") * HOT_KEYS < total).drop("n")
    often = rows.join(F.broadcast(hot), key)
    return often.union(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.hint("merge"), key))
