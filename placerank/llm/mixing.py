"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Training time runs from 0 to 1.  Source i has the weight schedule w_i(t) = w_i * (1 + slope_i * (t - 1/2)); its integral
over the run is w_i, so slopes move a source earlier or later without changing its share.  Shares become targets in words,
none above `repeats` times what the source holds, the excess reshared by weight.  The words a source takes are laid out in
hash order, pass after pass; the word at offset c is demanded at the time t at which the integrated schedule reaches
c / target.  Rows are range-sorted by that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placerank.llm.common import attach, materialise, small, spread_sums, word_count

WEIGHTS, SLOPES, REPEATS = (1, 2, 3), (-1.0, 0.0, 1.0), 3


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, repeats: int = REPEATS
) -> DataFrame:
    """source, n_rows, source_size, target, slope per source of (source, size) rows.

    Sources take the weights in turn, by code point with null last.  The table of sources, one aggregated row each, is the
    mix's configuration and passes one window task.  A source is cut off at `repeats` times its size exactly if that
    bound per weight is below the water level; sorted by that ratio the cut ones come first, so running sums give the level."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    nth = (F.row_number().over(Window.orderBy(F.encode("source", "utf-8").asc_nulls_last())) - 1) % F.lit(len(weights))
    per = per.withColumn("_nth", nth.cast("int"))
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("_nth") + 1))
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), F.col("_nth") % F.lit(len(slopes)) + 1)
    per = per.withColumn("_cap", repeats * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.encode("source", "utf-8").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.sum(F.col("source_size")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / weight)
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    ratio = (F.col("_cap") / F.col("_w")).alias("ratio")
    # of sources with one ratio the first has the highest level
    first = F.min(F.when(fits, F.struct(ratio, (-F.col("_level")).alias("down")))).over(everything)
    target = F.when(first.isNull() | (ratio < first["ratio"]), F.col("_cap")).otherwise(F.least(F.col("_cap"), -first["down"] * F.col("_w")))
    return per.select("source", "n_rows", "source_size", target.alias("target"), slope.alias("slope"))


def demanded_at(offset: Column, target: Column, slope: Column) -> Column:
    """Time at which the integrated schedule has demanded `offset` of `target` words: the root of
    slope/2 * t^2 + (1 - slope/2) * t = offset/target, in a form that holds for slope 0 as well."""
    u, b = offset / target, 1 - slope / 2
    return F.coalesce(F.try_divide(2 * u, b + F.sqrt(F.greatest(b * b + 2 * slope * u, F.lit(0.0)))), F.lit(0.0))


def mix(
    docs: DataFrame, repeats: int = REPEATS, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns `keep` of `docs` (default: all) in a struct `row`, with source, size, source_size, target, taken and the array `times`,
    one training time for every time the row is taken.

    A copy is taken if its middle word lies before the target, so a source misses its target by half a document at
    most.  Null and blank texts have size 0 and are never taken; null sources are one source; rows with equal doc_id
    are rows of their own, ordered by a hash of their text."""
    rows = docs.select(
        F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"),
        word_count(docs["text"]).cast("long").alias("size"), F.xxhash64(docs["text"]).alias("mark"),
    )
    if keep and "text" not in keep:
        rows = materialise(rows)  # narrow: read texts once
    targets = small(materialise(source_targets(rows.select("source", "size"), weights, slopes, repeats)))
    rows = spread_sums(rows, "source", "size", ["doc_id", "mark"], targets, "before")
    rows = attach(rows, targets.drop("n_rows"), ["source"])
    passes = F.array(*[F.lit(i).cast("long") for i in range(repeats)])
    offsets = F.transform(passes, lambda i: i * F.col("source_size") + F.col("before"))
    offsets = F.filter(offsets, lambda c: (F.col("size") > 0) & (c + F.col("size") / 2 < F.col("target")))
    rows = rows.withColumn("times", F.transform(offsets, lambda c: demanded_at(c.cast("double"), F.col("target"), F.col("slope"))))
    return rows.withColumn("taken", F.size("times") * F.col("size")).drop("before", "slope", "mark")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of `docs`, a row for each time it is taken, range-sorted by training time."""
    rows = mix(docs).select("row", "doc_id", F.explode("times").alias("time"))
    return rows.orderBy("time", "doc_id").select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_time of every row, in training order, rows not taken last."""
    rows = mix(docs, keep=["doc_id"])
    rows = rows.withColumn("first_time", F.element_at(F.concat("times", F.array(F.lit(None).cast("double"))), 1))
    rows = rows.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_time")
    return rows.orderBy(F.col("first_time").asc_nulls_last(), "doc_id")
