"""Joins that no hot key ties to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], most: int = 2000, total: int | None = None, small: int = 1_000_000) -> DataFrame:
    """``rows`` inner-joined to ``counts``, whose ``keys`` are unique and whose ``_rows`` says how many rows have them.

    Keys with more than a ``most``-th of all rows, of which there are fewer than ``most``, are broadcast, so no task
    takes such a key whole; the others meet in the shuffle. ``counts`` should be a written table: it is read three times.
    ``total`` is the number of rows where it is known already. At most ``small`` rows are joined plainly: no key of theirs
    is too large for a task.
    """
    total = total if total is not None else counts.agg(F.sum("_rows")).first()[0] or 0
    if total <= small:
        return rows.join(counts, keys)
    hot = counts.where(F.col("_rows") > total / most)
    met = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counts.where(F.col("_rows") <= total / most), keys)
    return met.unionByName(rest)
