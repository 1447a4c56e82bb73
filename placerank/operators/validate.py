"""Checks on incoming sightings and externally supplied answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.functions.lexicons import FESTIVE_WORDS
from placerank.functions.text import (
    clean_snippet,
    collapse_spaces,
    contains_any,
    is_date_only,
    phone_number,
    postal_code,
)
from placerank.operators.ordered import first_rows


def reject_reason(name: Column) -> Column:
    return (
        F.when(name.isNull() | (collapse_spaces(name) == ""), "empty name")
        .when(is_date_only(collapse_spaces(name)), "not a venue name")
    )


def validate_sightings(sightings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected).  Good rows have clean names and snippets, derived postal code and phone and
    a confidence within 0..1; rejected rows carry ``reject_reason``."""
    checked = sightings.withColumn("reject_reason", reject_reason(F.col("name")))
    good = (
        checked.where("reject_reason is null")
        .drop("reject_reason")
        .withColumns(
            {
                "name": collapse_spaces(F.col("name")),
                "postal_code": F.coalesce("postal_code", postal_code(F.col("address"))),
                "phone": F.coalesce("phone", phone_number(F.col("address"))),
                "snippet": clean_snippet(F.col("snippet")),
                "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))),
            }
        )
    )
    return good, checked.where("reject_reason is not null")


def valid_promos(answers: DataFrame, requested: DataFrame, today: str) -> DataFrame:
    """Promotions worth showing: the name was asked for, the source is https, it has not ended.

    ``answers``: name, deal, ends, url, position; ``requested``: name.  First one per venue."""
    asked = requested.select(F.lower("name").alias("_key"), F.col("name").alias("_name")).distinct()
    ends = F.try_to_date(F.substring("ends", 1, 10), "yyyy-MM-dd")
    rows = (
        answers.withColumn("_key", F.lower(F.trim("name")))
        .join(asked, "_key")
        .where(F.trim("deal") != "")
        .where(F.col("url").startswith("https://"))
        .where(ends.isNull() | (ends >= F.lit(today).cast("date")))
    )
    cleaned = rows.select(
        F.col("_name").alias("name"),
        F.trim("deal").alias("deal"),
        ends.cast("string").alias("ends"),
        "url",
        contains_any(F.lower("deal"), FESTIVE_WORDS).alias("festive"),
        "position",
    )
    return first_rows(cleaned, ["name"], ["position"])


def valid_closures(answers: DataFrame, requested: DataFrame) -> DataFrame:
    """Closure reports for requested names with an https source; first one per venue."""
    asked = requested.select(F.lower("name").alias("_key"), F.col("name").alias("_name")).distinct()
    rows = (
        answers.withColumn("_key", F.lower(F.trim("name")))
        .join(asked, "_key")
        .where(F.col("url").startswith("https://"))
        .select(F.col("_name").alias("name"), F.trim("note").alias("note"), "url", "position")
    )
    return first_rows(rows, ["name"], ["position"])


def overlay_answers(base: DataFrame, answers: DataFrame, allowed_tags: list[str]) -> DataFrame:
    """Externally computed review answers win field by field over the lexicon results.

    base: venue_id, texts, aspects, noise_level, summary, ambience_tags; answers: venue_id, aspects,
    noise_level, summary, dishes, tags.  Venues with fewer than two texts keep their own values."""
    a = answers.select(
        "venue_id",
        *[F.col(c).alias(f"_{c}") for c in ("aspects", "noise_level", "summary", "dishes", "tags")],
    )
    use = F.col("texts") >= 2
    own = F.map_filter("aspects", lambda k, _: ~F.coalesce(F.map_contains_key("_aspects", k), F.lit(False)))
    allowed = F.array_intersect(F.col("_tags"), F.array(*[F.lit(t) for t in allowed_tags]))
    answered = use & F.col("_aspects").isNotNull()
    return base.join(a, "venue_id", "left").select(
        "venue_id",
        F.when(answered, F.map_concat(own, "_aspects")).otherwise(F.col("aspects")).alias("aspects"),
        F.coalesce(F.when(use, F.col("_noise_level")), "noise_level").alias("noise_level"),
        F.coalesce(F.when(use, F.col("_summary")), "summary").alias("summary"),
        F.when(use, F.col("_dishes")).alias("dishes"),
        F.when(use & F.col("_tags").isNotNull(), F.array_union("ambience_tags", allowed))
        .otherwise(F.col("ambience_tags"))
        .alias("ambience_tags"),
    )
