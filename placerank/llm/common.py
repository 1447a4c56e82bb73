"""What several operators share: reading, checked broadcasts, word columns and running sums without a hot task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placerank.session import materialise

#: Rows up to which a side counts as small enough to broadcast; it is counted before, never assumed.
BROADCAST_ROWS = 100_000
#: ASCII white space: what separates words everywhere in this package.
SPACES = "\t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A whole table of the data set."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in order; null and blank texts have none."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def word_count(text: Column) -> Column:
    """How many words a text has: each is drawn together to one letter where it stands, and no array is made of them."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(marks) - F.length(F.replace(marks, F.lit("x"), F.lit("")))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if a count shows at most `rows` rows; else unchanged, so that it is shuffled.

    `df` should be cheap to count: a checkpoint or a small source."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe keys, keeping one copy of each key."""
    named = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(named, cond, how).drop(*[f"_k_{k}" for k in keys])


def attach_counted(df: DataFrame, table: DataFrame, key: str, rows: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each row of `df` with the row of `table` that has its `key`; rows without one are left out.

    `rows` of the table says how many rows of `df` have the key.  A small table is broadcast.  Else the keys with a
    thousandth of all rows or more (a thousand at most) are, and only the rows of light keys are shuffled.  `table` should be
    cheap to read twice: a checkpoint or a small source."""
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return attach(df, F.broadcast(table.drop(rows)), [key])
    every = table.agg(F.sum(rows)).first()[0]
    heavy = table.where(F.col(rows) * 1000 >= every).drop(rows)
    hot = heavy.select(F.col(key).alias("_hot"))
    light = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left_anti")
    return attach(df, F.broadcast(heavy), [key]).unionByName(attach(light, table.where(F.col(rows) * 1000 < every).drop(rows), [key]))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows at most, for fitting a model: all of a small table, else those whose hash of `key` falls under
    rows / count.  The same rows in every run; never more than twice `rows`."""
    n, span = df.count(), 1 << 40
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(span)) < int(span * rows / n)).limit(2 * rows)


def spread_sums(
    df: DataFrame, by: str, value: str, order: Sequence[str], stats: DataFrame, out: str = "before"
) -> DataFrame:
    """For each row the sum of `value` over the rows of its `by` group that stand before it.

    The order inside a group is that of a hash of `order`, then `order` itself: arbitrary but the same in every run.
    A group of n rows is cut into about sqrt(n) hash chunks; chunk totals and the rows of one chunk are summed in
    windows of about sqrt(n) rows each, so a group that holds a third of all rows is no hot task.  `stats` has one
    row per group: `by` and `n_rows`; wrap it in `small`."""
    cut = attach(df, stats.select(by, "n_rows"), [by])
    cut = cut.withColumn("_hash", F.xxhash64(*order))
    cut = cut.withColumn("_chunk", F.pmod("_hash", F.ceil(F.sqrt(F.col("n_rows"))).cast("long")))
    totals = cut.groupBy(by, "_chunk").agg(F.sum(value).alias("_total"))
    w = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(by, "_chunk", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_ahead"))
    w = Window.partitionBy(by, "_chunk").orderBy("_hash", *order).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_inside", F.coalesce(F.sum(value).over(w), F.lit(0)))
    done = attach(inside, totals, [by, "_chunk"])
    return done.withColumn(out, F.col("_ahead") + F.col("_inside")).drop("_ahead", "_inside", "_hash", "_chunk", "n_rows")


__all__ = ["BROADCAST_ROWS", "attach", "attach_counted", "materialise", "read", "small", "spread_sums", "word_count", "words"]
