"""The core job: stored sightings of a run -> registry, features, scores, ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.operators import merge, resolve, scoring, text
from placerank.params import Category, ScoringParams, category_table, weight_table
from placerank.session import materialise


@dataclass(frozen=True)
class RankedRun:
    registry: merge.Registry
    features: DataFrame
    scores: DataFrame
    assignments: DataFrame
    next_id: int


def venue_features(
    registry: merge.Registry,
    categories: list[Category],
    today: str,
    params: ScoringParams,
    buzz: DataFrame | None = None,
    history: DataFrame | None = None,
    answers: DataFrame | None = None,
) -> DataFrame:
    """Venue rows with everything scoring needs, computed once per venue.

    ``buzz``: venue_id, score (0..1); ``history``: venue_id, date, rating; ``answers``: venue_id and
    aspects that override the lexicon."""
    venues, evidence, reviews = registry.venues, registry.evidence, registry.reviews
    texts = text.venue_texts(evidence, reviews)
    words = sorted({k for c in categories for k in c.merged_keywords()})
    totals = text.keyword_totals(texts, words)
    main = F.try_element_at("ratings", F.lit(scoring.MAIN_SOURCE))["rating"]
    rated = venues.select("venue_id", main.alias("overall"))
    past = history if history is not None else rated.sparkSession.createDataFrame([], "venue_id string, date date, rating double")
    parts = [
        scoring.recommendations(evidence, today, params),
        merge.evidence_summary(evidence, params.min_confidence),
        text.keyword_maps(totals),
        text.category_hits(totals, categories),
        text.aspect_scores(texts),
        text.noise_substrings(texts.where("kind <> 'title'")),
        text.noise_counts(texts),
        text.secondhand_mentions(texts),
        text.rating_trend(past, reviews, rated, today),
    ]
    out = venues
    for part in parts:
        out = out.join(part, "venue_id", "left")
    if buzz is not None:
        out = out.join(buzz.select("venue_id", F.col("score").alias("buzz_score")), "venue_id", "left")
    else:
        out = out.withColumn("buzz_score", F.lit(None).cast("double"))
    if answers is not None:
        mine = answers.select("venue_id", F.col("aspects").alias("_aspects"))
        out = out.join(mine, "venue_id", "left").withColumn("aspects", F.coalesce("_aspects", "aspects")).drop("_aspects")
    tagged = lambda tag: F.array_contains("ambience_tags", tag).cast("long")
    zero = F.lit(0).cast("long")
    return out.withColumns(
        {
            "quiet_hits": F.coalesce("quiet_hits", zero) + tagged("quiet"),
            "loud_hits": F.coalesce("loud_hits", zero) + tagged("lively"),
            "noise_level": text.noise_level(
                F.coalesce("quiet_words", zero) + tagged("quiet"), F.coalesce("loud_words", zero) + tagged("lively")
            ),
            "independent_count": F.size(F.coalesce("independent_sources", F.array())),
            "buzz": F.col("buzz_score") * params.buzz_bonus_max,
            "parking": F.lit(None).cast("string"),
            "summary": F.lit(None).cast("string"),
        }
    )


def rank_venues(
    features: DataFrame,
    evidence: DataFrame,
    categories: list[Category],
    today: str,
    params: ScoringParams | None = None,
    personal: DataFrame | None = None,
    hide_visited: bool = False,
) -> DataFrame:
    """Scores with ranks for every (category, venue) in a category's pool."""
    spark = features.sparkSession
    table = category_table(spark, categories)
    pool = scoring.category_pool(evidence, table)
    scores = scoring.score_categories(
        features, pool, table, weight_table(spark, categories), today, params, personal, hide_visited
    )
    return scoring.rank_scores(scores)


def rank_run(
    sightings: DataFrame,
    sources: DataFrame,
    categories: list[Category],
    today: str,
    known_sightings: DataFrame | None = None,
    known: DataFrame | None = None,
    next_id: int = 1,
    params: ScoringParams | None = None,
    **more,
) -> RankedRun:
    """Resolve, merge, analyse, score and rank one run on top of what is already known.

    ``known_sightings``: assigned sightings of earlier runs; only venues this run touches are folded
    again, together with their past."""
    params = params or ScoringParams()
    done = resolve.resolve(sightings, known, next_id, params)
    assigned = done.assignments
    if known_sightings is not None:
        touched = assigned.select("venue_id").distinct()
        past = known_sightings.join(touched, "venue_id", "left_semi")
        assigned = assigned.unionByName(past, allowMissingColumns=True)
    registry = merge.build_registry(materialise(assigned), sources)
    registry = merge.Registry(
        materialise(registry.venues), registry.names, materialise(registry.evidence), materialise(registry.reviews)
    )
    personal = more.pop("personal", None)
    hide = more.pop("hide_visited", False)
    features = materialise(venue_features(registry, categories, today, params, **more))
    scores = rank_venues(features, registry.evidence, categories, today, params, personal, hide)
    return RankedRun(registry, features, scores, done.assignments, done.next_id)
