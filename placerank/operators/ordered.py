"""Ordered scans that never put a whole group into one task.

``row_number() over (partition by g order by o)`` sends every row of ``g`` to one
task.  A category, user or source may hold a third of all rows, so the scans here
work in two steps: range-partition by (group, order), which cuts a large group
into many chunks, then combine a scan inside each chunk with what the earlier
chunks of the group carry in.  Only one small row per (group, chunk) crosses over.

Top-k needs none of this: ``row_number() <= k`` is pruned per task before the
shuffle by Spark itself, see :func:`top_k`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.session import materialise

_CHUNK = "_chunk"


def _chunked(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with the number of the range partition they fell into.

    The range bounds come from a sample, so the rows are materialised: both the
    per-chunk totals and the rows themselves must see the same bounds.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    return materialise(df.repartitionByRange(parts, *keys).withColumn(_CHUNK, F.spark_partition_id()))


def _same_group(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    cond = left[_CHUNK] == right[_CHUNK]
    for c in by:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def _carry_in(totals: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """One row per (group, chunk): ``value`` folded over the group's earlier chunks."""
    before = Window.partitionBy(*by).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, _CHUNK, value.over(before).alias(name))


def row_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """``row_number`` per group.  ``order`` must be total, or ties are numbered arbitrarily."""
    rows = _chunked(df, by, order)
    sizes = rows.groupBy(*by, _CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _carry_in(sizes, by, F.sum("_n"), "_before")
    local = Window.partitionBy(*by, _CHUNK).orderBy(*order)
    rows = rows.withColumn("_local", F.row_number().over(local))
    joined = rows.join(offsets, _same_group(rows, offsets, by), "left")
    return joined.select(
        *[rows[c] for c in df.columns],
        (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("int").alias(name),
    )


def running_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per group."""
    rows = _chunked(df, by, order)
    sums = rows.groupBy(*by, _CHUNK).agg(F.sum(value).alias("_s"))
    carried = _carry_in(sums, by, F.sum("_s"), "_before")
    local = (
        Window.partitionBy(*by, _CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_local", F.sum(value).over(local))
    joined = rows.join(carried, _same_group(rows, carried, by), "left")
    return joined.select(
        *[rows[c] for c in df.columns],
        (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).alias(name),
    )


def fill_forward(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Latest non-null ``value`` at or before each row (ascending ``order`` columns) per group."""
    sort = [F.col(c).asc() for c in order]
    rows = _chunked(df, by, sort)
    last = F.max_by(F.when(F.col(value).isNotNull(), F.struct(value)), F.struct(*order))
    known = rows.where(F.col(value).isNotNull()).groupBy(*by, _CHUNK).agg(last.alias("_last"))
    chunks = rows.select(*by, _CHUNK).distinct()
    ends = chunks.join(known, _same_group(chunks, known, by), "left").select(
        *[chunks[c] for c in [*by, _CHUNK]], F.col("_last")[value].alias("_last")
    )
    carried = _carry_in(ends, by, F.last("_last", ignorenulls=True), "_before")
    local = (
        Window.partitionBy(*by, _CHUNK)
        .orderBy(*sort)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_local", F.last(value, ignorenulls=True).over(local))
    joined = rows.join(carried, _same_group(rows, carried, by), "left")
    return joined.select(
        *[rows[c] for c in df.columns], F.coalesce("_local", "_before").alias(name)
    )


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per group.  Spark keeps k rows per task and group before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per group by ascending ``order`` columns; a partial aggregate, not a window."""
    rest = [c for c in df.columns if c not in by]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(picked).select(*by, *[F.col("_row")[c].alias(c) for c in rest]).select(
        *df.columns
    )
