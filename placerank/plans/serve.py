"""Served queries: reports, the site dataset, search, lists and exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.functions.awards import award_label, is_buffet, star_count, verdict
from placerank.functions.lexicons import CUISINE_TABS
from placerank.functions.price import bill, cuisine_tabs, price_symbol, primary_cuisine
from placerank.functions.text import strip_chars
from placerank.operators.diff import is_new_venue
from placerank.operators.enrich import near_me
from placerank.operators.ordered import row_numbers, top_k
from placerank.params import ScoringParams

NAME_EDGES = " .·-"
# Site tab -> stored award
AWARD_TABS = {"michelin_3": "3 Stars", "michelin_2": "2 Stars", "michelin_1": "1 Star", "michelin_star": "Star"}


# --- joins used by several reports ----------------------------------------------------------------
def shown(scores: DataFrame) -> DataFrame:
    """Ranked, visible rows."""
    return scores.where((F.col("rank") > 0) & F.col("excluded_reason").isNull() & ~F.col("hidden"))


def with_backfill(run_venues: DataFrame, registry: DataFrame, ranked_ids: DataFrame) -> DataFrame:
    """Venues of the run, plus registry rows for ranked ids the run did not see."""
    older = registry.join(ranked_ids, "venue_id", "left_semi").join(run_venues.select("venue_id"), "venue_id", "left_anti")
    return run_venues.unionByName(older, allowMissingColumns=True)


def labelled_evidence(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence with the display name of its source; unknown sources show their key."""
    names = sources.select("source_key", "source_name")
    return evidence.join(names, "source_key", "left").withColumn("source_name", F.coalesce("source_name", "source_key"))


def newest_sources(evidence: DataFrame, sources: DataFrame, n: int = 6) -> DataFrame:
    """Per venue the n newest evidence links, each url once."""
    rows = labelled_evidence(evidence.where("url is not null and url <> ''"), sources)
    once = rows.groupBy("venue_id", "url").agg(
        F.min_by(
            F.struct("source_name", "title", "published_at"), F.struct(-F.col("confidence"), "source_key")
        ).alias("e")
    )
    rows = once.select(
        "venue_id", "url", F.col("e.source_name").alias("source"), F.coalesce("e.title", "e.source_name").alias("title"),
        F.col("e.published_at").alias("date"),
    )
    return top_k(rows, ["venue_id"], [F.col("date").desc_nulls_last(), F.col("url").asc()], n, "position")


def source_labels(newest: DataFrame) -> DataFrame:
    return newest.select("source").distinct()


def score_maps(scores: DataFrame) -> DataFrame:
    """(venue_id, scores MAP category -> score row); categories bound the map."""
    row = F.struct("score", "rank", "excluded_reason", "hidden")
    pairs = F.array_sort(F.collect_list(F.struct("category_key", row.alias("s"))))
    return scores.groupBy("venue_id").agg(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["category_key"], p["s"]))).alias("scores"))


def rank_index(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(venue_id, best_rank, lists, ranks array<struct<rank, label>>)."""
    rows = shown(scores).join(F.broadcast(labels.select("category_key", "label")), "category_key")  # configuration
    return rows.groupBy("venue_id").agg(
        F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("lists"),
        F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("ranks"),
    )


# --- reports ---------------------------------------------------------------------------------------
def category_report(scores: DataFrame, venues: DataFrame, categories: DataFrame, params: ScoringParams) -> DataFrame:
    """Rows of every category page with their section: top, rest, hidden or excluded."""
    section = (
        F.when(F.col("excluded_reason").isNotNull(), "excluded")
        .when(F.col("hidden"), "hidden")
        .when(F.col("rank") <= params.top_n, "top")
        .otherwise("rest")
    )
    facts = venues.drop("name")
    dims = categories.select("category_key", "display_name", "party_size")
    return scores.join(facts, "venue_id").join(F.broadcast(dims), "category_key").select(  # configuration
        "category_key", "display_name", section.alias("section"), "rank", "venue_id", "name", "region",
        price_symbol(F.col("price_level")).alias("price"), "michelin",
        bill(F.col("price_level"), dict(params.per_pax), F.col("party_size")).alias("bill"),
        F.round("score", 2).alias("score"), "excluded_reason",
    )


def weight_line(weights: DataFrame) -> DataFrame:
    """(category_key, weights) such as "rating 0.30, food 0.10", heaviest first."""
    live = weights.where("weight > 0")
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "component")))
    return live.groupBy("category_key").agg(
        F.array_join(F.transform(pairs, lambda p: F.format_string("%s %.2f", p["component"], -p["w"])), ", ").alias("weights")
    )


def venue_report(features: DataFrame, scores: DataFrame, categories: DataFrame, params: ScoringParams) -> DataFrame:
    """One row per venue: facts, ranks, exclusions, bills and the walk-in flag."""
    dims = categories.select("category_key", "party_size")
    ranked = scores.join(F.broadcast(dims), "category_key")  # configuration
    ok = F.col("excluded_reason").isNull()
    pairs = lambda *cols: F.array_sort(F.collect_list(F.when(ok, F.struct(*cols))))
    lists = ranked.groupBy("venue_id").agg(
        F.min(F.when(ok & (F.col("rank") > 0), F.col("rank"))).alias("best_rank"),
        F.map_from_entries(pairs("category_key", "rank")).alias("ranks"),
        F.map_from_entries(pairs("category_key", "party_size")).alias("_party"),
        F.array_sort(F.collect_list(F.when(~ok, F.struct("category_key", "excluded_reason")))).alias("exclusions"),
    )
    out = features.join(lists, "venue_id", "left")
    per_pax = bill(F.col("price_level"), dict(params.per_pax), F.lit(1))
    reservable = F.try_element_at("flags", F.lit("reservable"))
    return out.select(
        "venue_id", "name", "brand", "outlet", "address", "region", "cuisine", "price_level", "open_weekends",
        "best_rank", "ranks", "exclusions",
        F.when(per_pax.isNotNull(), F.transform_values("_party", lambda _, n: n * per_pax)).alias("bills"),
        (F.col("booking_url").isNull() & F.coalesce(~reservable, F.lit(False))).alias("walk_in_only"),
        "first_seen_run", "last_seen_run",
    )


def run_profile(sightings: DataFrame) -> DataFrame:
    """Sightings and distinct names per (category, source), per category, and overall, in one pass."""
    name = F.lower("name")
    grouped = sightings.select("category_key", "source_key", name.alias("n"))
    return grouped.groupingSets(
        [["category_key", "source_key"], ["category_key"], []], "category_key", "source_key"
    ).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("sightings"), F.count_distinct("n").alias("names")
    )


def top_names(sightings: DataFrame, n: int = 40) -> DataFrame:
    """Most frequent raw names among confident sightings."""
    sure = (F.coalesce("confidence", F.lit(1.0)) >= 0.5) & ~F.coalesce("extra.enrich_only", F.lit(False))
    counts = sightings.where(sure).groupBy("name").agg(F.count(F.lit(1)).alias("sightings"))
    return counts.orderBy(F.col("sightings").desc(), F.col("name")).limit(n)


def source_states(sources: DataFrame, sightings: DataFrame, skipped: DataFrame, selected: DataFrame) -> DataFrame:
    """(source_key, candidates, state): ran, ran without candidates, skipped (why), not selected."""
    counts = sightings.groupBy("source_key").agg(F.count(F.lit(1)).alias("candidates"))
    chosen = selected.select("source_key", F.lit(True).alias("_on"))
    out = sources.select("source_key").join(counts, "source_key", "left").join(skipped, "source_key", "left").join(chosen, "source_key", "left")
    state = (
        F.when(F.col("candidates").isNotNull(), "ran")
        .when(F.col("reason").isNotNull(), F.concat(F.lit("skipped: "), "reason"))
        .when(F.col("_on"), "ran (0 candidates)")
        .otherwise("not selected")
    )
    return out.select("source_key", F.coalesce("candidates", F.lit(0)).alias("candidates"), state.alias("state"))


def run_warnings(events: DataFrame, n: int = 60) -> DataFrame:
    bad = events.where(F.col("level").isin("warning", "error"))
    return bad.orderBy("at", "component", "message").limit(n).select("at", "level", "component", F.substring("message", 1, 140).alias("message"))


def collect_stats(events: DataFrame, sightings: DataFrame) -> DataFrame:
    """Per source: sightings, warnings and errors of a run."""
    seen = sightings.groupBy("source_key").agg(F.count(F.lit(1)).alias("candidates"))
    log = events.groupBy(F.col("component").alias("source_key")).agg(
        F.count_if(F.col("level") == "warning").alias("warnings"), F.count_if(F.col("level") == "error").alias("errors")
    )
    out = seen.join(log, "source_key", "full_outer")
    return out.select("source_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "warnings", "errors")])


def ranked_counts(scores: DataFrame) -> DataFrame:
    return shown(scores).groupBy("category_key").agg(F.count(F.lit(1)).alias("ranked"))


def recent_activity(events: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Activity of the last days, newest first when sorted by ``at`` descending."""
    day = F.lit(today).cast("date")
    return events.where(F.to_date("at").between(F.date_sub(day, days - 1), day))


# --- sentences ---------------------------------------------------------------------------------------
def join_words(items: Column) -> Column:
    """"a", "a and b", "a, b and c"."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(
        F.concat(head, F.lit(" and "), F.get(items, n - 1))
    )


def summary_sentence(source_names: Mapping[str, str]) -> Column:
    """One or two sentences from the structured fields of a feature row; at most three facts."""
    primary = primary_cuisine(F.col("cuisine"))
    kind = F.coalesce(F.lower(primary), F.lit("restaurant"))
    phrase = (
        F.when(kind.isin("cafe", "restaurant"), kind)
        .when(kind.isin("dessert", "high tea"), F.concat(kind, F.lit(" spot")))
        .otherwise(F.concat(primary, F.lit(" place")))
    )
    area = F.regexp_extract("district", r"^\S* (.*)$", 1)
    where = (
        F.when(area != "", F.concat(F.lit(" in "), area))
        .when(F.col("region").isNotNull(), F.concat(F.lit(" in the "), F.col("region")))
        .otherwise("")
    )
    price = (
        F.when(F.col("price_level") == 1, "budget friendly ").when(F.col("price_level") == 2, "mid priced ")
        .when(F.col("price_level") == 3, "upmarket ").when(F.col("price_level") == 4, "splurge ").otherwise("")
    )
    station = F.when(F.col("nearest_mrt").isNotNull(), F.concat(F.lit(", near "), F.col("nearest_mrt"), F.lit(" MRT"))).otherwise("")
    first = F.concat(F.col("name"), F.lit(" is a "), price, phrase, where, station, F.lit("."))

    order = F.array(*[F.lit(a) for a in ("food", "service", "ambience", "value")])
    having = lambda test: F.filter(order, lambda a: F.coalesce(test(F.try_element_at("aspects", a)), F.lit(False)))
    strong, weak = having(lambda s: s >= 0.7), having(lambda s: s <= 0.35)
    known = F.create_map(*[F.lit(x) for kv in source_names.items() for x in kv])
    picked = F.array_sort(F.array_compact(F.transform("independent_sources", lambda k: F.try_element_at(known, k))))
    n = F.size("independent_sources")
    google = F.try_element_at("ratings", F.lit("google_places"))
    says = lambda text, *cols: F.format_string(text, *cols)
    facts = F.array_compact(
        F.array(
            F.when(n >= 3, says("recommended by %d independent sources", n)).when(n > 0, says("picked by %s", join_words(picked))),
            F.when(F.col("michelin").isNotNull(), says("holds a Michelin %s", F.col("michelin"))),
            F.when(
                (google["rating"] > 0) & (google["review_count"] > 0),
                says("rated %.1f on Google over %,d reviews", google["rating"], google["review_count"]),
            ),
            F.when(F.size(strong) > 0, says("reviewers praise the %s", join_words(strong))),
            F.when(F.size(weak) > 0, says("but complaints mention %s", join_words(weak))),
            F.when(F.col("rating_trend") == "declining", "recent ratings are slipping").when(
                F.col("rating_trend") == "improving", "recent ratings are climbing"
            ),
        )
    )
    told = F.concat(F.lit("It is "), join_words(F.slice(facts, 1, 3)), F.lit("."))
    second = F.when(F.size(facts) > 0, F.regexp_replace(told, "^It is but", "Reviews do note")).otherwise("")
    return F.trim(F.concat_ws(" ", first, second))


def best_category(ranks: DataFrame, venues: DataFrame, categories: DataFrame) -> DataFrame:
    """(venue_id, category_key, category_group) a venue is best for: its best rank, but a category
    within two ranks whose keywords name the venue's cuisine goes first.

    ``ranks``: venue_id, category_key, rank; ``categories`` in display order with ``position``."""
    dims = categories.select("category_key", "category_group", "position", F.transform("keywords", lambda k: F.lower(k)).alias("_kw"))
    labels = venues.select("venue_id", F.transform("cuisine", lambda c: F.lower(c)).alias("_labels"))
    best = ranks.groupBy("venue_id").agg(F.min("rank").alias("_best"))
    rows = ranks.join(best, "venue_id").join(F.broadcast(dims), "category_key").join(labels, "venue_id")  # configuration
    affine = (F.col("rank") <= F.col("_best") + 2) & F.arrays_overlap("_kw", "_labels")
    picked = F.min_by(
        F.struct("category_key", "category_group"),
        F.struct((~F.coalesce(affine, F.lit(False))).alias("other"), "rank", "position"),
    )
    return rows.groupBy("venue_id").agg(picked.alias("b")).select("venue_id", "b.category_key", "b.category_group")


def best_for_phrase(key: Column, group: Column) -> Column:
    """Short phrase from the best category, tags and flags of a feature row."""
    tags = F.col("ambience_tags")
    flags = lambda k: F.coalesce(F.try_element_at("flags", F.lit(k)), F.lit(False))
    has = lambda w: F.contains(key, F.lit(w))
    view = F.arrays_overlap(tags, F.array(F.lit("rooftop"), F.lit("waterfront"), F.lit("view")))
    quiet = F.coalesce(F.col("noise_level") == "quiet", F.lit(False)) | F.array_contains(tags, "quiet")
    dating = (
        F.when(view, "a date with a view")
        .when(quiet & has("restaurants"), "a quiet anniversary dinner")
        .when(quiet, "a quiet coffee date")
        .when(has("brunch"), "a lazy weekend brunch date")
        .when(has("hightea"), "an afternoon tea date")
        .when(has("restaurants"), "a relaxed date night")
        .otherwise("a casual cafe date")
    )
    family = (
        F.when(has("private_room") | flags("private_room"), "a big family celebration with a private room")
        .when(has("steamboat"), "a long hotpot night with the whole family")
        .when(has("dimsum"), "a weekend dim sum brunch with grandparents")
        .when(has("zichar"), "a no-fuss zi char dinner with the family")
        .when(has("hawker"), "a cheap and cheerful family meal")
        .when(has("occasion") & flags("wheelchair"), "a birthday or reunion dinner with elderly relatives")
        .when(has("occasion"), "a birthday or reunion dinner")
        .when(flags("kid_friendly") & (flags("good_for_groups") | flags("private_room")), "a big family lunch with kids in tow")
        .when(flags("kid_friendly"), "a weekend meal with young kids")
        .otherwise("a family weekend meal")
    )
    kind = F.lower(F.coalesce(primary_cuisine(F.col("cuisine")), F.lit("place")))
    return (
        F.when(key.isNull(), "not ranked yet")
        .when(group == "dating", dating)
        .when(group == "family", family)
        .otherwise(F.concat(F.lit("trying a new "), kind, F.lit(" this month")))
    )


# --- the served site ---------------------------------------------------------------------------------
def hide_listed(scores: DataFrame, venues: DataFrame, hidden_names: DataFrame) -> DataFrame:
    """Scores without venues whose trimmed name is on the hide list."""
    gone = (
        venues.select("venue_id", strip_chars(F.col("name"), NAME_EDGES).alias("name"))
        .join(hidden_names.select("name").distinct(), "name", "left_semi")
        .select("venue_id")
    )
    return scores.join(gone, "venue_id", "left_anti")


def award_tabs(ranked: DataFrame, venues: DataFrame) -> DataFrame:
    """The stars list split into one tab per award, renumbered from 1 in list order.

    ``ranked``: venue_id, rank of the stars list."""
    tab = F.lit(None).cast("string")
    for key, award in reversed(AWARD_TABS.items()):
        tab = F.when(F.col("michelin") == award, key).otherwise(tab)
    rows = ranked.join(venues.select("venue_id", "michelin"), "venue_id").withColumn("category_key", tab)
    rows = rows.where("category_key is not null").select("category_key", "venue_id", F.col("rank").alias("_rank"))
    return row_numbers(rows, ["category_key"], [F.col("_rank").asc(), F.col("venue_id").asc()], "rank").drop("_rank")


def site_venues(
    features: DataFrame, index: DataFrame, run_id: str, bootstrap: str, in_new_list: DataFrame,
    promos: DataFrame, dishes: DataFrame, params: ScoringParams,
) -> DataFrame:
    """One row per ranked venue with everything the page shows, worth and new included.

    ``index``: see :func:`rank_index`; ``promos`` and ``dishes`` join by exact name."""
    from placerank.functions.geo import run_time

    google = F.try_element_at("ratings", F.lit("google_places"))
    sources = F.size(F.coalesce("source_keys", F.array()))
    judged = verdict(
        F.col("business_status"), google["rating"], google["review_count"], F.col("hygiene_grade"),
        F.col("michelin"), F.col("rating_trend"), F.col("best_rank"), sources,
    )
    flags = lambda k: F.coalesce(F.try_element_at("flags", F.lit(k)), F.lit(False))
    fresh = in_new_list.select("venue_id").distinct().withColumn("_in_new", F.lit(True))
    rows = (
        features.join(index, "venue_id")
        .join(fresh, "venue_id", "left")
        .join(promos.select("name", F.struct("deal", "ends", "url", "festive").alias("promo")), "name", "left")
        .join(dishes.select("name", F.col("dishes").alias("_dishes")), "name", "left")
    )
    new = is_new_venue(
        F.col("first_seen_run"), run_time(F.lit(run_id)), bootstrap, F.coalesce("_in_new", F.lit(False))
    )
    rows = rows.withColumns({"_v": judged, "dishes": F.coalesce("_dishes", F.array().cast("array<string>"))})
    blob = F.concat_ws(" ", "name", F.array_join("cuisine", " "), "summary", F.array_join("dishes", " "), F.array_join("ambience_tags", " "))
    return rows.select(
        "venue_id", strip_chars(F.col("name"), NAME_EDGES).alias("name"), "name_zh", "address", "district",
        "region", "lat", "lng", "cuisine", cuisine_tabs(blob).alias("cuisines"), "price_level",
        bill(F.col("price_level"), dict(params.per_pax), F.lit(1)).alias("per_pax"),
        google["rating"].alias("rating"), google["review_count"].alias("reviews"),
        award_label(F.col("michelin")).alias("michelin"), flags("halal").alias("halal"),
        flags("kid_friendly").alias("kids"), is_buffet(F.col("name"), F.col("cuisine"), F.col("summary")).alias("buffet"),
        F.col("ambience_tags").alias("tags"), "open_weekends", "booking_url", "summary", "dishes", "promo",
        new.alias("new"), F.col("_v.worth").alias("worth"), F.col("_v.reason").alias("why"), "best_rank", "lists", "ranks",
    )


def curated_list(curated: DataFrame, finds: DataFrame, site: DataFrame, pattern: str) -> DataFrame:
    """Hand-picked places first, then scraped finds that are plainly of that kind.

    ``curated``: list_key, position, venue_id, site_only, name; ``finds``: venue_id, rank."""
    known = curated.join(site.select("venue_id", F.col("name").alias("_n")), "venue_id", "left")
    picked = known.where(F.col("site_only") | F.col("_n").isNotNull()).select(
        "venue_id", F.coalesce("name", "_n").alias("name"), F.struct(F.lit(0).alias("part"), F.col("position").cast("int").alias("at")).alias("o")
    )
    blob = F.concat_ws(" ", "name", F.array_join("cuisine", " "), "summary", F.array_join("dishes", " "))
    rows = finds.join(site, "venue_id").where(blob.rlike("(?iU)" + pattern))
    rows = rows.join(picked.select("venue_id"), "venue_id", "left_anti")
    names = picked.select(F.lower("name").alias("_k")).distinct()
    rows = rows.join(names, F.lower(rows["name"]) == F.col("_k"), "left_anti").select(
        "venue_id", "name", F.struct(F.lit(1).alias("part"), F.col("rank").cast("int").alias("at")).alias("o")
    )
    return row_numbers(picked.union(rows), [], [F.col("o").asc(), F.col("venue_id").asc()], "rank").drop("o")


def group_counts(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_key, places): distinct venues over a group's categories; ``groups``: group_key, category_key."""
    rows = shown(scores).join(F.broadcast(groups), "category_key")  # configuration
    return rows.groupBy("group_key").agg(F.count_distinct("venue_id").alias("places"))


def all_places(site: DataFrame) -> DataFrame:
    """Every place in one list: worth going, best rank, number of lists, name."""
    order = [
        F.col("worth").desc(), F.coalesce("best_rank", F.lit(999)).asc(), F.coalesce("lists", F.lit(0)).desc(),
        F.collate("name", "UNICODE").asc(), F.col("venue_id").asc(),
    ]
    return row_numbers(site, [], order, "position")


def cuisine_lists(places: DataFrame) -> DataFrame:
    """The "All" order per cuisine tab, renumbered; ``places`` from :func:`all_places`."""
    rows = places.select("venue_id", "position", F.explode("cuisines").alias("cuisine"))
    return row_numbers(rows, ["cuisine"], [F.col("position").asc()], "rank").drop("position")


def cuisine_labels() -> list[str]:
    return list(CUISINE_TABS)


def deals(site: DataFrame) -> DataFrame:
    return site.where("promo is not null").select("venue_id", "name", "promo")


def site_totals(site: DataFrame) -> DataFrame:
    return site.agg(
        F.count(F.lit(1)).alias("places"), F.count_if(F.col("worth")).alias("worth"), F.count_if(F.col("new")).alias("new"),
        F.count_if(F.col("michelin").isNotNull()).alias("awarded"),
    )


# --- interactive queries -------------------------------------------------------------------------------
def serving_filter(
    worth: bool = False, region: str | None = None, max_price: int | None = None, halal: bool = False,
    weekend: bool = False, awarded: bool = False, new: bool = False,
) -> Column:
    """Facets of the page; an unknown price or unknown weekend hours pass."""
    ok = F.lit(True)
    if worth:
        ok = ok & F.col("worth")
    if region:
        ok = ok & (F.col("region") == region)
    if max_price:
        ok = ok & (F.coalesce("price_level", F.lit(0)) <= max_price)
    if halal:
        ok = ok & F.col("halal")
    if weekend:
        ok = ok & F.coalesce("open_weekends", F.lit(True))
    if awarded:
        ok = ok & F.col("michelin").isNotNull()
    if new:
        ok = ok & F.col("new")
    return ok


def text_filter(query: str, columns: list[Column]) -> Column:
    """Every word of the query is a substring of the joined columns."""
    hay = F.lower(F.concat_ws(" ", *columns))
    ok = F.lit(True)
    for word in query.lower().split():
        ok = ok & F.contains(hay, F.lit(word))
    return ok


def search_venues(
    site: DataFrame, query: str = "", near: tuple[float, float, float | None] | None = None, limit: int = 30,
    offset: int = 0, **facets,
) -> DataFrame:
    """One page of results: by distance when ``near`` (lat, lng, radius in km) is given, else by rank."""
    names = ["name", "name_zh", "district", "region", "address"]
    hay = [F.col(c) for c in names if c in site.columns]
    hay += [F.array_join(c, " ") for c in ("cuisine", "cuisines", "tags") if c in site.columns]
    rows = site.where(serving_filter(**facets))
    if query:
        rows = rows.where(text_filter(query, hay))
    if near:
        rows = near_me(rows, *near).orderBy(F.col("distance_km").asc(), F.col("venue_id").asc())
    else:
        rows = rows.orderBy(F.coalesce("best_rank", F.lit(999)).asc(), F.col("venue_id").asc())
    return rows.offset(offset).limit(limit)


def occasion_list(scores: DataFrame, features: DataFrame, category: str, params: ScoringParams, n: int = 20) -> DataFrame:
    """Special occasion picks: more stars first, then rank."""
    ranked = shown(scores).where(F.col("category_key") == category).select("venue_id", "rank")
    rows = ranked.join(features, "venue_id").withColumn("stars", star_count(F.coalesce("michelin", F.lit(""))))
    return rows.orderBy(F.col("stars").desc(), "rank").limit(n).select(
        "venue_id", "name", "stars", "rank", award_label(F.col("michelin")).alias("award"),
        bill(F.col("price_level"), dict(params.per_pax), F.lit(4)).alias("bill_for_4"),
    )


def tracked_names(scores: DataFrame, venues: DataFrame, categories: DataFrame, per_list: int = 8, digest: int = 12) -> DataFrame:
    """Names at the top of every list, in list order, each once: (name, position).

    ``categories``: category_key, position, digest_only."""
    dims = categories.select("category_key", F.col("position").alias("_list"), "digest_only")
    top = scores.where((F.col("rank") > 0) & F.col("excluded_reason").isNull()).join(F.broadcast(dims), "category_key")  # configuration
    limit = F.when(F.col("digest_only"), digest).otherwise(per_list)
    rows = top.where(F.col("rank") <= limit).join(venues.select("venue_id", F.col("name").alias("_name")), "venue_id")
    first = rows.groupBy(F.col("_name").alias("name")).agg(F.min(F.struct("_list", "rank")).alias("at"))
    return first.select("name", F.col("at._list").alias("list"), F.col("at.rank").alias("rank"))


def recheck_queue(names: DataFrame, checked: DataFrame, closed: DataFrame, n: int = 24) -> DataFrame:
    """Names to re-check next: not known closed, never checked first, then the oldest check."""
    rows = names.join(closed.select("name"), "name", "left_anti").join(checked, "name", "left")
    return rows.orderBy(F.col("checked").asc_nulls_first(), "list", "rank").limit(n).select("name", "checked")


def dashboard_table(features: DataFrame, scores: DataFrame, category: str | None, params: ScoringParams) -> DataFrame:
    """Flat venue rows of one category (or all venues unranked); sort by rank nulls last, then name."""
    google = F.try_element_at("ratings", F.lit("google_places"))
    flags = lambda k: F.coalesce(F.try_element_at("flags", F.lit(k)), F.lit(False))
    if category:
        mine = shown(scores).where(F.col("category_key") == category).select("venue_id", "rank", F.round("score", 3).alias("score"))
        rows = features.join(mine, "venue_id")
    else:
        rows = features.withColumns({"rank": F.lit(None).cast("int"), "score": F.lit(None).cast("double")})
    return rows.select(
        "venue_id", "rank", "score", "name", "region", "district", F.array_join("cuisine", ", ").alias("cuisine"),
        F.coalesce(price_symbol(F.col("price_level")), F.lit("")).alias("price"),
        bill(F.col("price_level"), dict(params.per_pax), F.lit(1)).alias("per_pax"),
        google["rating"].alias("google_rating"), google["review_count"].alias("google_reviews"),
        flags("halal").alias("halal"), flags("kid_friendly").alias("kid_friendly"),
        F.coalesce("michelin", F.lit("")).alias("michelin"), F.coalesce("business_status", F.lit("")).alias("status"),
        "lat", "lng",
    )


def dashboard_filter(
    regions: list[str] | None = None, budget: int = 4, halal: bool = False, kids: bool = False,
    hide_closed: bool = True, station: str | None = None, trending: bool = False,
) -> Column:
    ok = F.length("price") <= budget
    if regions:
        ok = ok & F.col("region").isin(*regions)
    if halal:
        ok = ok & F.col("halal")
    if kids:
        ok = ok & F.col("kid_friendly")
    if hide_closed:
        ok = ok & ~F.col("status").startswith("CLOSED")
    if station:
        ok = ok & F.coalesce(F.contains(F.lower("nearest_mrt"), F.lit(station.lower())), F.lit(False))
    if trending:
        ok = ok & F.col("trending")
    return ok


def wishlist(personal: DataFrame, venues: DataFrame) -> DataFrame:
    """Places the user wants to go to; sort by google_rating descending."""
    rating = F.try_element_at("ratings", F.lit("google_places"))["rating"]
    wanted = personal.where("status = 'wishlist'")
    return wanted.join(venues, "venue_id").select("venue_id", "name", "region", "price_level", rating.alias("google_rating"))


# --- exports -----------------------------------------------------------------------------------------
RAW_COLUMNS = [
    "source_key", "category_key", "query", "name", "name_zh", "address", "postal_code", "lat", "lng", "phone",
    "website", "booking_url", "rating", "review_count", "price_level", "price_text", "cuisine", "business_status",
    "michelin", "hygiene_grade", "confidence", "page_url", "source_ref", "captured_at",
]


def raw_export(sightings: DataFrame) -> DataFrame:
    """Sightings as flat columns for CSV; lists are joined."""
    return sightings.select(*[F.array_join(c, "; ").alias(c) if c == "cuisine" else F.col(c) for c in RAW_COLUMNS])


def merged_export(features: DataFrame, scores: DataFrame) -> DataFrame:
    """One JSON text per venue with its scores by category."""
    out = features.join(score_maps(scores), "venue_id", "left")
    return out.select("venue_id", F.to_json(F.struct(*[c for c in out.columns if c not in ("hours",)])).alias("json"))


def category_export(scores: DataFrame, features: DataFrame, categories: DataFrame, params: ScoringParams) -> DataFrame:
    """Rows of the ranked CSV files (write partitioned by category_key); unknown values are blank."""
    google = F.try_element_at("ratings", F.lit("google_places"))
    flag = lambda k: F.try_element_at("flags", F.lit(k))
    aspect = lambda a: F.try_element_at("aspects", F.lit(a))
    dims = categories.select("category_key", "party_size")
    rows = scores.join(features.drop("name"), "venue_id").join(F.broadcast(dims), "category_key")  # configuration
    est = bill(F.col("price_level"), dict(params.per_pax), F.col("party_size"))
    columns = {
        "rank": F.nullif("rank", F.lit(0)),
        "score": F.when(F.col("excluded_reason").isNull(), F.format_string("%.4f", "score")),
        **{c: F.col(c) for c in ("venue_id", "name", "name_zh", "brand", "outlet", "address", "postal_code", "district", "region", "lat", "lng")},
        "cuisine": F.array_join("cuisine", "; "),
        "price_level": price_symbol(F.nullif("price_level", F.lit(0))),
        "bill_estimate_sgd": F.format_string("%.0f", est),
        "google_rating": google["rating"], "google_reviews": google["review_count"],
        "independent_sources": F.col("independent_count"), "sources": F.array_join("source_keys", "; "),
        **{c: F.col(c) for c in ("michelin", "hygiene_grade", "open_weekends", "booking_url", "website", "phone")},
        **{c: flag(c) for c in ("kid_friendly", "private_room", "halal")},
        "earliest_evidence": F.col("earliest_evidence"), "rating_trend": F.col("rating_trend"),
        **{f"aspect_{a}": aspect(a) for a in ("food", "service", "ambience", "value")},
        "noise_level": F.col("noise_level"), "summary": F.col("summary"), "buzz_score": F.nullif("buzz_score", F.lit(0.0)),
        "hidden": F.col("hidden"), "excluded_reason": F.col("excluded_reason"),
    }
    for late in ("nearest_mrt", "mrt_lines", "best_for", "trending_social", "social_mentions_6m"):
        if late in features.columns:
            columns[late] = F.array_join(late, "; ") if late == "mrt_lines" else F.col(late)
    return rows.select("category_key", *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in columns.items()])
