"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows on; there are at most 1 / HEAVY such keys, whatever the size of the data.
HEAVY = 0.001


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row per key and in ``count`` the number of rows of the key.

    Rows whose key is null or not in the table are left out.  Heavy keys are broadcast (a bounded number), only the rows of light
    keys are shuffled.  ``table`` is read twice: pass a checkpoint."""
    every = table.agg(F.sum(count)).first()[0] or 0
    heavy = F.broadcast(table.where(F.col(count) >= max(1.0, HEAVY * every)).drop(count))
    light = table.where(F.col(count) < max(1.0, HEAVY * every)).drop(count)
    cold = rows.join(heavy.select(*keys), list(keys), "left_anti")
    return rows.join(heavy, list(keys)).unionByName(cold.join(light, list(keys)))
