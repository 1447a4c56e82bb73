"""Nested documents taken apart level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from placerank.session import settle


def all_levels(first: DataFrame, below: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``first``, those ``below`` them, and so on until a level has none; any depth, one pass per level.

    ``below`` keeps the columns.  Every level is checkpointed: a level reads the one above it, never the source again."""
    level = settle(first)
    found = level
    while not level.isEmpty():
        level = settle(below(level))
        found = found.unionByName(level)
    return found
