"""Field merge policies: assigned sightings -> venue rows and their child tables.

Every policy of the merge is an aggregate over ``ord`` (see ``resolve.with_ingest_order``), so a
venue with a third of all sightings is folded by partial aggregates like any other.  Bounded things
(labels, tags, flags, ratings per source) become arrays and maps; unbounded ones stay tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.functions.awards import award_from_text
from placerank.functions.base import truthy
from placerank.functions.geo import sector_region
from placerank.functions.hours import hours_flags, opening_hours
from placerank.functions.lexicons import AMBIENCE_WORDS, PRIVATE_ROOM
from placerank.functions.names import brand_outlet
from placerank.functions.price import cuisines, price_level
from placerank.functions.text import contains_any, is_date_only, strip_news_wording, without_fragment
from placerank.operators.ordered import top_k

SNIPPETS_PER_VENUE = 12
# venue flag -> field of the sighting's extra struct
FLAG_FIELDS = {
    "kid_friendly": "good_for_children",
    "good_for_groups": "good_for_groups",
    "outdoor_seating": "outdoor_seating",
    "wheelchair": "wheelchair_accessible_entrance",
    "reservable": "reservable",
    "vegetarian_options": "serves_vegetarian_food",
    "pet_friendly": "allows_dogs",
}


def first_of(value: Column, keep: Column | None = None) -> Column:
    """First non-null value in ingest order, among the rows where ``keep`` holds."""
    ok = value.isNotNull() if keep is None else value.isNotNull() & keep
    return F.min_by(value, F.when(ok, F.col("ord")))


def last_of(value: Column, keep: Column | None = None) -> Column:
    ok = value.isNotNull() if keep is None else value.isNotNull() & keep
    return F.max_by(value, F.when(ok, F.col("ord")))


def first_unless(value: Column, preferred: Column) -> Column:
    """The preferred source's latest value wins; otherwise the first one seen."""
    return F.coalesce(last_of(value, preferred), first_of(value))


def evidence_url(ref: Column, page_url: Column, website: Column) -> Column:
    return F.when(ref.startswith("http"), without_fragment(ref)).otherwise(
        F.coalesce(truthy(page_url), website)
    )


def published_date(extra: Column) -> Column:
    """Article date, else the thread's creation date; the capture date never counts."""
    thread = F.to_date(F.timestamp_seconds(extra["thread_created_utc"])).cast("string")
    dated = F.when(extra["thread_created_utc"] != 0, thread)
    return F.coalesce(truthy(extra["published_at"]), dated)


def evidence_table(assigned: DataFrame, independent: DataFrame) -> DataFrame:
    """One row per (venue, source, url): first values win, categories and queries are united.

    ``independent``: (source_key, independent), the source dimension."""
    url = evidence_url(F.col("source_ref"), F.col("page_url"), F.col("website"))
    title = F.coalesce(truthy(F.col("extra.article_title")), F.col("extra.thread_title"))
    rows = assigned.where("venue_id is not null").select(
        "venue_id", "source_key", "ord", "category_key", "query", "run_id", url.alias("url"),
        F.struct(
            title.alias("title"), published_date(F.col("extra")).alias("published_at"), "snippet",
            "rating", "review_count", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "captured_at",
        ).alias("first"),
    )
    merged = rows.groupBy("venue_id", "source_key", "url").agg(
        F.min_by("first", "ord").alias("f"),
        F.array_sort(F.collect_set("category_key")).alias("category_keys"),
        F.array_sort(F.collect_set("query")).alias("queries"),
        F.max("run_id").alias("run_id"),
    )
    return merged.join(independent.select("source_key", "independent"), "source_key", "left").select(
        "venue_id", "source_key", "url", "f.title", "f.published_at", "category_keys", "queries",
        "f.snippet", "f.rating", "f.review_count", "f.confidence",
        F.coalesce("independent", F.lit(False)).alias("independent"), "f.captured_at", "run_id",
    )


def review_table(assigned: DataFrame, limit: int = SNIPPETS_PER_VENUE) -> DataFrame:
    """First ``limit`` distinct review snippets of every venue."""
    rows = assigned.where("venue_id is not null").select(
        "venue_id", F.col("source_key").alias("source"), "ord", F.posexplode("extra.reviews").alias("pos", "r")
    )
    distinct = (
        rows.where(truthy(F.col("r.snippet")).isNotNull())
        .groupBy("venue_id", F.col("r.snippet").alias("snippet"))
        .agg(
            F.min(F.struct("ord", "pos")).alias("at"),
            F.min_by(F.struct("source", "r.rating", "r.published_at"), F.struct("ord", "pos")).alias("f"),
        )
    )
    kept = top_k(distinct, ["venue_id"], [F.col("at").asc()], limit)
    return kept.select("venue_id", "f.source", "f.rating", "f.published_at", "snippet", F.col("rank").alias("position"))


def name_table(assigned: DataFrame) -> DataFrame:
    """Every raw name a venue was seen under, with the first sighting's order."""
    return (
        assigned.where("venue_id is not null")
        .groupBy("venue_id", F.col("name").alias("alias"))
        .agg(F.min("ord").alias("first_ord"))
    )


def _in_order(values: DataFrame, name: str) -> DataFrame:
    """(venue_id, value, at) -> (venue_id, array in order of first appearance); few distinct values."""
    first = values.groupBy("venue_id", "value").agg(F.min("at").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "value")))
    return first.groupBy("venue_id").agg(F.transform(listed, lambda x: x["value"]).alias(name))


def cuisine_lists(assigned: DataFrame) -> DataFrame:
    labels = assigned.where("venue_id is not null").select(
        "venue_id", "ord", F.posexplode(cuisines(F.col("cuisine"))).alias("pos", "value")
    )
    return _in_order(labels.select("venue_id", "value", F.struct("ord", "pos").alias("at")), "cuisine")


def rating_maps(assigned: DataFrame) -> DataFrame:
    """Latest rating per source; the reservation view of the main source repeats it and is left out."""
    rated = assigned.where(
        "venue_id is not null and rating is not null and source_key <> 'google_reserve'"
    )
    latest = rated.groupBy("venue_id", "source_key").agg(
        F.max_by(F.struct("rating", "review_count"), "ord").alias("value")
    )
    pairs = F.array_sort(F.collect_list(F.struct("source_key", "value")))
    return latest.groupBy("venue_id").agg(F.map_from_entries(pairs).alias("ratings"))


def _tag_columns(text: Column) -> dict[str, Column]:
    """Aggregates giving the order in which each ambience tag first appeared."""
    return {
        f"_tag_{tag}": F.min(F.when(contains_any(text, words), F.col("ord")))
        for tag, words in AMBIENCE_WORDS.items()
    }


def merge_venues(assigned: DataFrame) -> DataFrame:
    """One row per venue with every flat field of ``schemas.VENUE``."""
    rows = assigned.where("venue_id is not null")
    google = F.col("source_key") == "google_places"
    any_google = F.col("source_key").isin("google_places", "google_reserve")
    reserve = F.col("source_key") == "google_reserve"
    lines, free_text = F.col("opening_hours.weekday_descriptions"), F.col("opening_hours.text")
    rows = rows.withColumns(
        {
            "_text": F.lower(
                F.concat_ws(
                    " ", truthy(F.col("snippet")), truthy(F.col("extra.article_title")), truthy(F.col("query"))
                )
            ),
            "_level": F.coalesce(
                truthy(F.col("price_level"), "number"), price_level(F.col("price_text"))
            ),
            "_hours": opening_hours(lines, free_text),
            "_award": F.coalesce(truthy(F.col("michelin")), award_from_text(F.col("snippet"))),
            "_halal_label": F.array_contains(cuisines(F.col("cuisine")), "Halal"),
        }
    )
    text = F.col("_text")
    explicit = truthy(F.col("michelin"))
    flags = {f"_flag_{k}": last_of(F.col(f"extra.{v}")) for k, v in FLAG_FIELDS.items()}
    reviews = F.coalesce(F.col("extra.reviews"), F.array())
    tags = _tag_columns(text)
    merged = rows.groupBy("venue_id").agg(
        F.min_by("name", "ord").alias("_raw_name"),
        first_of(truthy(F.col("name_zh"))).alias("name_zh"),
        first_unless(truthy(F.col("address")), google).alias("address"),
        first_unless(truthy(F.col("postal_code")), google).alias("postal_code"),
        first_unless(truthy(F.col("lat"), "number"), google).alias("lat"),
        first_unless(truthy(F.col("lng"), "number"), google).alias("lng"),
        first_unless(truthy(F.col("phone")), google).alias("phone"),
        first_unless(truthy(F.col("website")), google).alias("website"),
        F.coalesce(
            last_of(truthy(F.col("booking_url")), ~reserve), first_of(truthy(F.col("booking_url")), reserve)
        ).alias("booking_url"),
        last_of(truthy(F.col("source_ref")), any_google).alias("google_place_id"),
        first_unless(F.col("_level"), google).alias("price_level"),
        first_of(truthy(F.col("price_text"))).alias("price_text"),
        first_unless(F.col("_hours"), F.size(lines) > 0).alias("hours"),
        last_of(truthy(F.col("business_status"))).alias("business_status"),
        last_of(truthy(F.col("hygiene_grade"))).alias("hygiene_grade"),
        F.coalesce(last_of(explicit, explicit != "Selected"), first_of(F.col("_award"))).alias("michelin"),
        *[v.alias(k) for k, v in flags.items()],
        F.bool_or(text.rlike("(?iU)" + PRIVATE_ROOM)).alias("_private"),
        F.bool_or(F.contains(text, F.lit("halal")) | F.col("_halal_label")).alias("_halal"),
        *[v.alias(k) for k, v in tags.items()],
        F.sum(
            F.aggregate(
                reviews, F.lit(0).cast("long"),
                lambda n, r: n + F.coalesce(r["social_words"], F.lit(0)),
            )
        ).alias("social_words"),
        F.min("run_id").alias("first_seen_run"),
        F.max("run_id").alias("last_seen_run"),
        F.min(
            F.array_min(F.transform(reviews, lambda r: F.substring(truthy(r["published_at"]), 1, 10)))
        ).alias("_first_review"),
        F.min(published_date(F.col("extra"))).alias("_first_article"),
    )
    name = strip_news_wording(F.col("_raw_name"))
    split = brand_outlet(name)
    flag_values = {k: F.col(f"_flag_{k}") for k in FLAG_FIELDS}
    flag_values["private_room"] = F.when(F.col("_private"), True)
    flag_values["halal"] = F.when(F.col("_halal"), True)
    flag_map = F.map_from_arrays(
        F.array(*[F.lit(k) for k in flag_values]), F.array(*flag_values.values())
    )
    seen_tags = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"_tag_{t}").isNotNull(), F.struct(F.col(f"_tag_{t}").alias("at"), F.lit(i).alias("pos"), F.lit(t).alias("tag")))
                for i, t in enumerate(AMBIENCE_WORDS)
            ]
        )
    )
    region = sector_region(F.col("postal_code"))
    hours = hours_flags(F.col("hours"))
    out = merged.withColumns({"name": name, "_split": split, "_region": region, "_hf": hours})
    out = out.join(cuisine_lists(rows), "venue_id", "left").join(rating_maps(rows), "venue_id", "left")
    return out.select(
        "venue_id", "name", "name_zh",
        F.when(F.col("_split.outlet").isNotNull(), F.col("_split.brand")).alias("brand"),
        F.col("_split.outlet").alias("outlet"),
        "address", "postal_code", "_region.district", "_region.region", "lat", "lng", "phone",
        "website", "booking_url", "google_place_id",
        F.coalesce("cuisine", F.array().cast("array<string>")).alias("cuisine"),
        "price_level", "price_text", "hours",
        "_hf.open_weekends", "_hf.late_night", "_hf.ph_closed",
        "business_status", "michelin", "hygiene_grade",
        F.map_filter(flag_map, lambda _, v: v.isNotNull()).alias("flags"),
        F.transform(F.array_sort(seen_tags), lambda t: t["tag"]).alias("ambience_tags"),
        F.coalesce("ratings", F.create_map().cast("map<string,struct<rating:double,review_count:int>>")).alias("ratings"),
        "social_words",
        F.least("_first_review", "_first_article").alias("earliest_evidence"),
        "first_seen_run", "last_seen_run",
    )


@dataclass(frozen=True)
class Registry:
    """All stored knowledge about venues."""

    venues: DataFrame
    names: DataFrame
    evidence: DataFrame
    reviews: DataFrame


def build_registry(assigned: DataFrame, sources: DataFrame) -> Registry:
    """Registry of all assigned sightings (of one run, or of every run so far)."""
    return Registry(
        merge_venues(assigned),
        name_table(assigned),
        evidence_table(assigned, sources),
        review_table(assigned),
    )


def evidence_summary(evidence: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Per venue: distinct sources, independent sources, categories without the catch-all."""
    good = F.col("independent") & (F.col("confidence") >= min_confidence)
    base = evidence.groupBy("venue_id").agg(
        F.array_sort(F.collect_set("source_key")).alias("source_keys"),
        F.array_sort(F.collect_set(F.when(good, F.col("source_key")))).alias("independent_sources"),
    )
    categories = (
        evidence.select("venue_id", F.explode("category_keys").alias("c"))
        .where("c <> '*'")
        .groupBy("venue_id")
        .agg(F.array_sort(F.collect_set("c")).alias("category_keys"))
    )
    return base.join(categories, "venue_id", "left").withColumn(
        "category_keys", F.coalesce("category_keys", F.array().cast("array<string>"))
    )


def refresh_venues(venues: DataFrame, evidence: DataFrame) -> DataFrame:
    """Re-derive stored columns with today's rules: names, price levels, awards from snippets.

    Levels of API-backed venues and of plain "$$" texts stay; awards stay when the guide itself
    listed the venue."""
    awards = evidence.groupBy("venue_id").agg(
        F.bool_or(F.col("source_key") == "michelin").alias("_guide"),
        F.min_by(
            award_from_text(F.col("snippet")),
            F.when(
                award_from_text(F.col("snippet")).isNotNull(),
                F.struct(-F.col("confidence"), "source_key", "url"),
            ),
        ).alias("_award"),
    )
    name = strip_news_wording(F.col("name"))
    split = brand_outlet(name)
    symbols = F.trim("price_text").rlike(r"^\${1,4}$")
    reread = truthy(F.col("price_text")).isNotNull() & F.col("google_place_id").isNull() & ~symbols
    out = venues.join(awards, "venue_id", "left").withColumns({"_name": name, "_split": split})
    renamed = F.col("_name") != F.col("name")
    columns = {
        "name": F.col("_name"),
        "brand": F.when(renamed, F.when(F.col("_split.outlet").isNotNull(), F.col("_split.brand"))).otherwise(F.col("brand")),
        "outlet": F.when(renamed, F.col("_split.outlet")).otherwise(F.col("outlet")),
        "price_level": F.when(reread, price_level(F.trim("price_text"))).otherwise(F.col("price_level")),
        "michelin": F.when(F.coalesce("_guide", F.lit(False)), F.col("michelin")).otherwise(F.col("_award")),
    }
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in venues.columns])


def prune_evidence(
    evidence: DataFrame, venues: DataFrame, queries: DataFrame, sources: DataFrame, relevant
) -> DataFrame:
    """Re-check stored blog evidence; adds ``dropped`` so that callers can count and filter.

    ``queries``: (query, category_key) configuration; ``relevant(url, query)``: Column predicate.
    Blog rows keep the queries their article answers and the categories of those; rows without any
    are dropped, as is all evidence of venues named by a date only."""
    blogs = sources.where("kind = 'blog'").select("source_key", F.lit(True).alias("_blog"))
    dated = venues.where(is_date_only(F.col("name"))).select("venue_id", F.lit(True).alias("_dated"))
    rows = evidence.join(blogs, "source_key", "left").join(dated, "venue_id", "left")
    check = F.col("_blog").isNotNull() & truthy(F.col("url")).isNotNull() & (F.size("queries") > 0)
    kept = F.filter("queries", lambda q: relevant(F.col("url"), q))
    rows = rows.withColumns({"_check": F.coalesce(check, F.lit(False)), "_kept": kept})
    key = ["venue_id", "source_key", "url"]
    derived = (
        rows.where("_check")
        .select(*key, F.explode("_kept").alias("query"))
        .join(queries, "query")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set(F.col("category_key"))).alias("_categories"))
    )
    out = rows.join(derived, key, "left")
    return out.select(
        *[
            {
                "queries": F.when(F.col("_check"), F.col("_kept")).otherwise(F.col("queries")).alias("queries"),
                "category_keys": F.coalesce("_categories", "category_keys").alias("category_keys"),
            }.get(c, F.col(c))
            for c in evidence.columns
        ],
        (F.coalesce("_dated", F.lit(False)) | (F.col("_check") & (F.size("_kept") == 0))).alias("dropped"),
    )
