"""Writers: run partitions, the versioned registry, append-only logs, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.operators.merge import Registry
from placerank.plans.serve import raw_export

_TABLES = ("venues", "names", "evidence", "reviews")


def write_run(df: DataFrame, path: str, by: tuple[str, ...] = ("run_id",)) -> None:
    """Append one run's rows under run_id=... folders."""
    df.write.partitionBy(*by).mode("append").parquet(path)


def write_registry(registry: Registry, root: str, version: str, next_id: int) -> None:
    """Write a new version next to the old ones, then append the pointer row that makes it current.

    The version being read is never overwritten, so a failed write changes nothing."""
    for name in _TABLES:
        getattr(registry, name).write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    spark = registry.venues.sparkSession
    pointer = spark.createDataFrame([(version, next_id)], "version string, next_id long")
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/versions")


def read_registry(spark: SparkSession, root: str) -> tuple[Registry, int]:
    """The latest completed version and its next free id."""
    last = spark.read.parquet(f"{root}/versions").orderBy(F.col("version").desc()).first()
    tables = [spark.read.parquet(f"{root}/{last['version']}/{name}") for name in _TABLES]
    return Registry(*tables), last["next_id"]


def append_log(df: DataFrame, path: str) -> None:
    """Merge audit, unmatched mentions, activity: append-only JSON lines."""
    df.write.mode("append").json(path)


def write_raw_export(sightings: DataFrame, path: str) -> None:
    raw_export(sightings).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    sightings.write.mode("overwrite").json(f"{path}/json")


def write_category_csvs(rows: DataFrame, path: str) -> None:
    """One folder per category, rows sorted as ranked: listed first, hidden and excluded last."""
    position = F.coalesce(F.col("rank").try_cast("int"), F.lit(2**31 - 1))
    ordered = rows.repartitionByRange("category_key", position, "name").sortWithinPartitions("category_key", position, "name")
    ordered.write.partitionBy("category_key").mode("overwrite").option("header", True).csv(path)


def write_site(sections: dict[str, DataFrame], path: str) -> None:
    """The served document: JSON lines per section."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def unmatched_log(mentions: DataFrame, guesses: DataFrame, known: DataFrame) -> DataFrame:
    """New unmatched mentions with their best guesses, ready to be resolved by hand."""
    rows = mentions.where("matched_by = 'unmatched'").join(known.select("key"), "key", "left_anti")
    tops = guesses.groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "venue_id", "score"))), lambda g: F.struct(g["venue_id"], g["score"])).alias("candidates")
    )
    return rows.join(tops, "key", "left").select(
        "run_id", "source", "url", "caption", "creator_handle", "candidates", F.lit(None).cast("string").alias("resolved_venue_id")
    )


def manual_resolutions(unmatched: DataFrame) -> DataFrame:
    """(url, venue_id) of rows resolved by hand."""
    done = unmatched.where("resolved_venue_id is not null and resolved_venue_id <> '' and url is not null")
    return done.groupBy("url").agg(F.max("resolved_venue_id").alias("venue_id"))
