"""Scores: components, weights, adjustments, filters and ranks.

Venue features are computed once per venue; categories (a configuration table) join afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.functions.awards import award_level, is_buffet, star_count
from placerank.functions.base import iso_date, lookup
from placerank.functions.lexicons import HOTEL, NOT_A_PLACE
from placerank.operators.ordered import first_rows, row_numbers
from placerank.params import COMPONENTS, ScoringParams
from placerank.session import materialise, spread

MAIN_SOURCE = "google_places"
# Parking flag -> component
PARKING = {"own": 1.0, "public_nearby": 0.7, "street": 0.4, "none": 0.0}


# --- components ----------------------------------------------------------------------------------
def bayesian(rating: Column, count: Column, p: ScoringParams) -> Column:
    """Rating shrunk towards the prior by review count, mapped from 1..5 stars to 0..1."""
    n = F.greatest(F.lit(0.0), F.coalesce(count.cast("double"), F.lit(0.0)))
    prior, m = F.lit(float(p.prior_reviews)), F.lit(float(p.prior_rating))
    value = ((prior * m + n * rating) / (prior + n) - 1.0) / 4.0
    return F.when(rating.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def recency(published: Column, today: str, p: ScoringParams) -> Column:
    """Half-life decay of dated evidence; undated and very old evidence get fixed weights."""
    age = F.greatest(F.lit(0.0), F.date_diff(F.lit(today).cast("date"), published) / F.lit(p.days_per_month))
    return (
        F.when(published.isNull(), F.lit(p.undated_weight))
        .when(age > p.stale_years * 12.0, F.lit(p.stale_weight))
        .otherwise(F.pow(F.lit(0.5), age / F.lit(p.half_life_months)))
    )


def recommendations(evidence: DataFrame, today: str, p: ScoringParams) -> DataFrame:
    """Per venue: sum of recency times confidence over independent evidence, one per (source, url)."""
    good = evidence.where(F.col("independent") & (F.col("confidence") >= p.min_confidence))
    weight = recency(iso_date(F.col("published_at")), today, p) * F.col("confidence")
    return good.groupBy("venue_id").agg(F.sum(weight).alias("recommendations"))


def distinct_evidence(evidence: DataFrame, order: list[str]) -> DataFrame:
    """First row per (venue, source, url) in ``order``."""
    return first_rows(evidence, ["venue_id", "source_key", "url"], order)


def best_rating(ratings: DataFrame) -> DataFrame:
    """Per venue the main source's rating, else the one with most reviews (earliest on ties).

    ``ratings``: venue_id, source_key, rating, review_count, position."""
    main = F.col("source_key") == MAIN_SOURCE
    order = F.struct(
        main.alias("main"), F.coalesce("review_count", F.lit(0)).alias("n"), (-F.col("position")).alias("p")
    )
    best = F.max_by(F.struct("rating", "review_count", "source_key"), order)
    return (
        ratings.where("rating is not null")
        .groupBy("venue_id")
        .agg(best.alias("b"))
        .select("venue_id", "b.rating", "b.review_count", "b.source_key")
    )


def best_rating_of_map(ratings: Column) -> Column:
    """The same choice on a MAP source -> (rating, review_count) of one venue row."""
    entries = F.filter(F.map_entries(ratings), lambda e: e["value"]["rating"].isNotNull())
    ranked = F.transform(
        entries,
        lambda e, i: F.struct(
            (e["key"] == MAIN_SOURCE).alias("main"),
            F.coalesce(e["value"]["review_count"], F.lit(0)).alias("n"),
            (-i).alias("p"),
            e["value"].alias("value"),
        ),
    )
    return F.array_max(F.transform(ranked, lambda r: F.struct(r["main"], r["n"], r["p"], r["value"])))["value"]


def keyword_match(hits: Column) -> Column:
    """0 without hits (its weight stays in force); 20 hits and more approach or pass 1."""
    return F.when(F.coalesce(hits, F.lit(0)) > 0, F.log1p(hits) / F.log1p(F.lit(20))).otherwise(F.lit(0.0))


def noise_component(quiet: Column, loud: Column) -> Column:
    return F.when(quiet + loud > 0, quiet / (quiet + loud))


def flag(flags: Column, key: str) -> Column:
    return F.try_element_at(flags, F.lit(key))


def space_component(flags: Column) -> Column:
    groups, room = flag(flags, "good_for_groups"), F.coalesce(flag(flags, "private_room"), F.lit(False))
    known = groups.isNotNull() | room
    return F.when(known, F.when(F.coalesce(groups, F.lit(False)) | room, 1.0).otherwise(0.3))


def yes_no(value: Column) -> Column:
    """1, 0 or unknown."""
    return F.when(value.isNotNull(), value.cast("double"))


def venue_components(
    aspects: Column, hits: Column, quiet: Column, loud: Column, p: ScoringParams
) -> dict[str, Column]:
    """Every weight component of a venue row; null means "no data"."""
    best = best_rating_of_map(F.col("ratings"))
    return {
        "rating": bayesian(best["rating"], best["review_count"], p),
        "recommendations": F.coalesce("recommendations", F.lit(0.0)),
        "keyword_match": keyword_match(hits),
        "food": F.try_element_at(aspects, F.lit("food")),
        "service": F.try_element_at(aspects, F.lit("service")),
        "ambience": F.coalesce(
            F.try_element_at(aspects, F.lit("ambience")), F.when(F.size("ambience_tags") > 0, 0.7)
        ),
        "value": F.try_element_at(aspects, F.lit("value")),
        "space": space_component(F.col("flags")),
        "kid_friendly": yes_no(flag(F.col("flags"), "kid_friendly")),
        "parking": lookup(PARKING, F.col("parking")),
        "weekend_open": yes_no(F.col("open_weekends")),
        "quiet": noise_component(quiet, loud),
        "michelin": award_level(F.col("michelin")),
    }


# --- weights -------------------------------------------------------------------------------------
def total_of(values: Iterable[Column]) -> Column:
    """Sum of the known values, in order."""
    return reduce(lambda a, v: a + F.coalesce(v, F.lit(0.0)), values, F.lit(0.0))


def known_of(values: Mapping[str, Column]) -> Column:
    """MAP of the known values."""
    whole = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def live_weights(components: Mapping[str, Column], weights: Mapping[str, Column]) -> dict[str, Column]:
    """Weights in force: those above zero of components with data."""
    return {k: F.when(v.isNotNull() & (weights[k] > 0), weights[k]) for k, v in components.items() if k in weights}


def weighted_parts(components: Mapping[str, Column], live: Mapping[str, Column], total: Column) -> dict[str, Column]:
    """Share of every component in the score: weights of components without data go to the others.

    ``total`` is the sum of ``live`` as a column of its own, since every share mentions it."""
    return {k: F.when(total > 0, components[k].cast("double") * (w / total)) for k, w in live.items()}


def adjustments(
    award: Column, independent: Column, buzz: Column, trend: Column, hygiene: Column, status: Column, p: ScoringParams
) -> dict[str, Column]:
    """Bonuses and penalties; null where one does not apply."""
    return {
        "michelin": F.when(F.coalesce(award, F.lit("")) != "", F.lit(p.award_bonus)),
        "multi_source": F.when(independent >= p.multi_source_threshold, F.lit(p.multi_source_bonus)),
        "buzz": F.when(buzz > 0, F.least(F.lit(p.buzz_bonus_max), buzz)),
        "declining_trend": F.when(trend == "declining", F.lit(-p.declining_penalty)),
        "poor_hygiene": F.when(F.upper(hygiene).isin("C", "D"), F.lit(-p.hygiene_penalty)),
        "temporarily_closed": F.when(status == "CLOSED_TEMPORARILY", F.lit(-p.closed_penalty)),
    }


def personal_blend(score: Column, my_rating: Column, p: ScoringParams) -> Column:
    """Mix in the user's own rating, then clamp to 0..1."""
    own = F.greatest(F.lit(0.0), F.least(F.lit(5.0), my_rating)) / 5.0
    blended = F.lit(1.0 - p.personal_weight) * score + F.lit(p.personal_weight) * own
    mixed = F.when(my_rating.isNotNull(), blended).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))


def share_of_maximum(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``value`` divided by its maximum within ``by``; unchanged when that is zero.

    The maxima are an aggregate of a few rows joined back: no group passes through one task."""
    top = rows.groupBy(*by).agg(F.max(value).alias("_max"))
    joined = rows.join(top, by)
    share = F.when(F.col("_max") > 0, F.col(value) / F.col("_max")).otherwise(F.col(value))
    return joined.select(*[share.alias(c) if c == value else F.col(c) for c in rows.columns])


# --- filters -------------------------------------------------------------------------------------
def with_traits(venues: DataFrame) -> DataFrame:
    """Add what the filters need to know of a venue's name and awards, once per venue."""
    award, name = F.col("michelin"), F.col("name")
    exempt = (star_count(F.coalesce(award, F.lit(""))) > 0) | F.coalesce(award == "Bib Gourmand", F.lit(False))
    return venues.withColumns(
        {
            "not_a_place": name.rlike("(?iU)" + NOT_A_PLACE),
            "hotel": name.rlike("(?iU)" + HOTEL),
            "price_exempt": exempt | F.coalesce(is_buffet(name, F.col("cuisine"), F.col("summary")), F.lit(False)),
            "award_kind": F.when(award_level(award) == 0.5, "bib").when(award_level(award).isNotNull(), "star"),
        }
    )


def hard_filter_reason(today: str, p: ScoringParams, own_query: Column) -> Column:
    """First reason that keeps a venue out of a category, null when it may be ranked.

    Works on :func:`with_traits` columns joined with ``params.category_table``; ``own_query`` says that a
    query of this very category found the venue.  Unknown never counts against a venue, except where
    the category asks for proof."""
    level = F.col("price_level")
    known = level.isNotNull() & (level != 0)
    flags = F.col("flags")
    kind = F.col("award_kind")
    per_pax = lookup({k: float(v) for k, v in p.per_pax.items()}, level)
    bill = per_pax * F.col("party_size")
    tiers, text = F.col("price_levels"), F.lit
    days = F.when(F.col("opened_within_months") == 1, F.lit(p.new_within_days)).otherwise(
        F.floor(F.col("opened_within_months") * F.lit(p.days_per_month)).cast("int")
    )
    earliest = iso_date(F.col("earliest_evidence"))
    money = lambda x: F.format_string("S$%.0f", x)
    rules = [
        (F.col("not_a_place"), text("not a place to eat")),
        (F.col("exclude_closed") & (F.col("business_status") == "CLOSED_PERMANENTLY"), text("closed permanently")),
        (F.col("need_weekends") & (F.col("open_weekends") == F.lit(False)), text("not open on weekends")),
        (F.col("need_private_room") & ~F.coalesce(flag(flags, "private_room"), F.lit(False)), text("no private room evidence")),
        (F.col("need_halal") & ~F.coalesce(flag(flags, "halal"), F.lit(False)), text("not halal")),
        (known & (level > F.col("max_price_level")), F.format_string("price level %d above %d", level, F.col("max_price_level"))),
        (F.col("price_required") & ~known & ~F.col("price_exempt"), text("no price level")),
        (
            F.col("awards").isNotNull() & ~F.coalesce(F.array_contains("awards", kind), F.lit(False)),
            F.when(F.array_contains("awards", "star"), "no Michelin star").otherwise("not Bib Gourmand"),
        ),
        ((F.array_max(tiers) <= 2) & F.col("hotel"), text("hotel, not a cheap or affordable place")),
        (tiers.isNotNull() & level.isNull() & ~own_query, text("no price level")),
        (level.isNotNull() & ~F.array_contains(tiers, level), F.format_string("price level %d not in this tier", level)),
        (
            F.col("bill_low").isNotNull() & known & ~bill.between(F.col("bill_low"), F.col("bill_high")),
            F.concat(text("estimated bill "), money(bill), text(" outside "), money(F.col("bill_low")), text(" to "), money(F.col("bill_high"))),
        ),
        (
            F.col("opened_within_months").isNotNull() & (F.coalesce("earliest_evidence", text("")) == ""),
            text("no dated evidence for opening"),
        ),
        (F.col("opened_within_months").isNotNull() & earliest.isNull(), text("undated opening evidence")),
        (
            F.col("opened_within_months").isNotNull() & (F.date_add(earliest, days) < F.lit(today).cast("date")),
            F.concat(text("earliest evidence "), earliest.cast("string"), text(" is older than "), days.cast("string"), text(" days")),
        ),
    ]
    chain = None
    for condition, reason in rules:
        chain = F.when(condition, reason) if chain is None else chain.when(condition, reason)
    return chain


# --- ranking -------------------------------------------------------------------------------------
def category_pool(evidence: DataFrame, categories: DataFrame) -> DataFrame:
    """(category_key, venue_id, own_query): venues found by a category's queries or by those of the
    categories it also draws from."""
    found = evidence.select("venue_id", F.explode("category_keys").alias("found_by"))
    pools = categories.select("category_key", F.explode("pool").alias("found_by"))
    return (
        found.join(F.broadcast(pools), "found_by")  # configuration: a handful of rows
        .groupBy("category_key", "venue_id")
        .agg(F.bool_or(F.col("found_by") == F.col("category_key")).alias("own_query"))
    )


def rank_scores(scores: DataFrame) -> DataFrame:
    """Add ``rank``: 1..n by score and name over visible rows of a category, 0 for the others.

    ``scores``: category_key, venue_id, name, score, excluded_reason, hidden, ..."""
    scores = materialise(scores)  # read three times below
    visible = F.col("excluded_reason").isNull() & ~F.col("hidden")
    order = [F.round("score", 9).desc(), F.col("name").asc(), F.col("venue_id").asc()]
    ranked = row_numbers(scores.where(visible), ["category_key"], order, "rank")
    return ranked.unionByName(scores.where(~visible).withColumn("rank", F.lit(0)))


def score_categories(
    venues: DataFrame,
    pool: DataFrame,
    categories: DataFrame,
    weights: DataFrame,
    today: str,
    params: ScoringParams | None = None,
    personal: DataFrame | None = None,
    hide_visited: bool = False,
) -> DataFrame:
    """Score every pooled venue in every category (without ranks).

    ``venues``: flat venue columns plus the features recommendations, aspects, keyword_hits (MAP
    category -> hits), quiet_hits, loud_hits, independent_count, buzz, rating_trend, summary."""
    p = params or ScoringParams()
    dims = weights.groupBy("category_key").pivot("component", list(COMPONENTS)).agg(F.first("weight"))
    dims = dims.select("category_key", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"w_{c}") for c in COMPONENTS])
    config = categories.drop("queries", "keywords", "pool").join(dims.select("category_key"), "category_key")
    comps = venue_components(F.col("aspects"), F.lit(None).cast("int"), F.col("quiet_hits"), F.col("loud_hits"), p)
    fixed = {k: v for k, v in comps.items() if k != "keyword_match"}
    kept = [
        "venue_id", "name", "price_level", "business_status", "open_weekends", "flags", "michelin", "hygiene_grade",
        "earliest_evidence", "keyword_hits", "independent_count", "buzz", "rating_trend", "not_a_place", "hotel",
        "price_exempt", "award_kind",
    ]
    # traits, reasons and sums are long expressions over few bytes: the join below keeps this number of partitions
    once = with_traits(spread(venues, "venue_id")).select(*kept, *[v.alias(f"c_{k}") for k, v in fixed.items()])
    if personal is not None:
        mine = personal.select("venue_id", F.col("status").alias("my_status"), "my_rating")
        once = once.join(mine, "venue_id", "left")
    else:
        once = once.withColumns({"my_status": F.lit(None).cast("string"), "my_rating": F.lit(None).cast("double")})
    rows = pool.join(F.broadcast(config), "category_key").join(once, "venue_id")  # configuration
    reason = F.when(F.col("my_status") == "excluded", "excluded by you").otherwise(
        hard_filter_reason(today, p, F.col("own_query"))
    )
    rows = rows.select(
        "category_key", "venue_id", "name", reason.alias("excluded_reason"), "my_status", "my_rating",
        "business_status", "hygiene_grade", F.col("michelin").alias("award"), "independent_count", "buzz",
        "rating_trend", *[F.col(f"c_{k}") for k in fixed],
        keyword_match(F.try_element_at("keyword_hits", F.col("category_key"))).alias("c_keyword_match"),
    )
    rows = materialise(rows)  # the maxima need every row before any is scored
    ok = F.col("excluded_reason").isNull()
    tops = rows.where(ok).groupBy("category_key").agg(F.max("c_recommendations").alias("_max"))
    rows = rows.join(F.broadcast(tops), "category_key", "left")  # configuration: or all rows would be dealt by a few categories
    rows = rows.join(F.broadcast(dims), "category_key")  # configuration
    relative = F.when(F.col("_max") > 0, F.col("c_recommendations") / F.col("_max")).otherwise(F.col("c_recommendations"))
    values = {k: (relative if k == "recommendations" else F.col(f"c_{k}")) for k in comps}
    live = live_weights(values, {c: F.col(f"w_{c}") for c in COMPONENTS})
    scored = rows.withColumn("_total", total_of(live.values()))
    parts = weighted_parts(values, live, F.col("_total"))
    extra = adjustments(
        F.col("award"), F.col("independent_count"), F.col("buzz"), F.col("rating_trend"), F.col("hygiene_grade"), F.col("business_status"), p
    )
    raw = total_of(parts.values()) + total_of(extra.values())
    mine = F.when(F.col("my_rating").isNotNull(), F.create_map(F.lit("personal"), F.lit(p.personal_weight))).otherwise(
        F.create_map().cast("map<string,double>")
    )
    empty = F.create_map().cast("map<string,double>")
    hidden = F.lit(hide_visited) & F.coalesce(F.col("my_status") == "visited", F.lit(False)) & ok
    return scored.select(
        "category_key", "venue_id", "name",
        F.when(ok, personal_blend(raw, F.col("my_rating"), p)).otherwise(F.lit(0.0)).alias("score"),
        F.when(ok, known_of(parts)).otherwise(empty).alias("components"),
        F.when(ok, F.map_concat(known_of(extra), mine)).otherwise(empty).alias("adjustments"),
        "excluded_reason", hidden.alias("hidden"),
    )
