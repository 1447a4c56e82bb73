"""Stored runs: sightings, pages, events; raw exports and the versioned registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.schemas import PAGE, RUN_EVENT, SIGHTING


def read_sightings(
    spark: SparkSession, path: str, run_id: str | None = None, source_key: str | None = None
) -> DataFrame:
    """Sightings of JSON-lines files under run_id=.../source_key=... folders (partition pruning).

    Lines that do not parse are kept in ``_corrupt_record`` for inspection."""
    df = (
        spark.read.schema(SIGHTING + ", _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    if source_key is not None:
        df = df.where(F.col("source_key") == source_key)
    return df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_EVENT).json(path)


def read_personal(notes: DataFrame) -> DataFrame:
    """User notes -> venue_id, status, my_rating; rows that say nothing are dropped.

    ``notes``: venue_id, status, my_rating (text), excluded (boolean)."""
    status = F.when(F.col("excluded"), "excluded").otherwise(F.nullif("status", F.lit("")))
    rows = notes.select("venue_id", status.alias("status"), F.col("my_rating").try_cast("double").alias("my_rating"))
    return rows.where("status is not null or my_rating is not null")


def expand_queries(categories: DataFrame, sources: DataFrame) -> DataFrame:
    """Search plan: categories x queries x sources; catalogue sources get one "*" query.

    Both inputs are configuration tables of tens of rows; they meet on the category groups a source
    applies to."""
    groups = ["dating", "family", "general"]
    every = F.array(*[F.lit(g) for g in groups])
    by_group = sources.select(
        "source_key", "query_driven", F.explode(F.coalesce("applies_to", every)).alias("category_group")
    )
    queries = categories.select("category_key", "category_group", "party_size", F.explode("queries").alias("query"))
    driven = queries.join(by_group.where("query_driven"), "category_group").select(
        "source_key", "category_key", "category_group", "query", "party_size"
    )
    catalogue = sources.where(~F.col("query_driven")).select(
        "source_key", F.lit("*").alias("category_key"), F.lit("general").alias("category_group"),
        F.lit("*").alias("query"), F.lit(2).alias("party_size"),
    )
    return driven.union(catalogue)


def curated_rows(curated: DataFrame) -> DataFrame:
    """Hand-picked places -> list_key, position, venue_id (given, or prefix + position), fields.

    ``curated``: list_key, prefix, entries array<struct<id, name, summary, dishes>>."""
    rows = curated.select("list_key", "prefix", F.posexplode("entries").alias("pos", "e"))
    made = F.format_string("%s%03d", F.col("prefix"), F.col("pos") + 1)
    return rows.select(
        "list_key", (F.col("pos") + 1).alias("position"), F.coalesce("e.id", made).alias("venue_id"),
        F.col("e.id").isNull().alias("site_only"), "e.name", "e.summary", "e.dishes",
    )
