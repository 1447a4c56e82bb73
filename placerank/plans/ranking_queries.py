"""Registered queries of the ranking family with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.operators import merge, scoring
from placerank.operators.ordered import row_numbers, top_k
from placerank.params import category_table, weight_table
from placerank.plans import serve
from placerank.plans.standins import (
    CATEGORIES,
    PARAMS,
    SIGHTINGS,
    TODAY,
    VENUES,
    duck,
    duck_evidence,
    evidence,
    personal,
    sightings,
    venues,
)
from placerank.session import materialise, spread

S, V, E = duck(SIGHTINGS), duck(VENUES), duck_evidence()
RECENCY = f"""CASE WHEN published_at IS NULL THEN CAST(0.5 AS DOUBLE)
  WHEN greatest(0, DATE '{TODAY}' - CAST(published_at AS DATE)) / CAST(30.4 AS DOUBLE) > 48 THEN CAST(0.05 AS DOUBLE)
  ELSE pow(CAST(0.5 AS DOUBLE), greatest(0, DATE '{TODAY}' - CAST(published_at AS DATE)) / CAST(30.4 AS DOUBLE) / CAST(18 AS DOUBLE)) END"""
BAYES = "greatest(0, least(1, ((CAST(100 AS DOUBLE) * CAST(4.2 AS DOUBLE) + review_count * rating) / (CAST(100 AS DOUBLE) + review_count) - 1) / 4))"


# --- components ------------------------------------------------------------------------------------
def ratings(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """Latest rating per (venue, source); the newest sighting, then the dearest, then the largest."""
    order = F.struct(F.coalesce("published_at", F.lit("")).alias("p"), "price", "quantity", "review_count")
    return (
        (sightings(spark, sf_dir) if seen is None else seen)
        .groupBy("venue_id", "source_key")
        .agg(F.max_by(F.struct("rating", "review_count"), order).alias("r"))
        .select("venue_id", "source_key", "r.rating", "r.review_count")
    )


DUCK_RATINGS = f"""
SELECT venue_id, source_key, arg_max(rating, o) AS rating, arg_max(review_count, o) AS review_count
FROM (SELECT *, {{'a': coalesce(published_at, ''), 'b': price, 'c': quantity, 'd': review_count}} AS o FROM ({S}))
GROUP BY venue_id, source_key"""
DUCK_BEST = f"""
SELECT venue_id, arg_max(rating, o) AS rating, arg_max(review_count, o) AS review_count, arg_max(source_key, o) AS source_key
FROM (SELECT *, {{'a': review_count, 'b': -CAST(substr(source_key, 4) AS INT)}} AS o FROM ({DUCK_RATINGS})) GROUP BY venue_id"""


def bayesian_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratings(spark, sf_dir).withColumn("position", F.expr("cast(substr(source_key, 4) as int)"))
    best = scoring.best_rating(rows)
    value = scoring.bayesian(F.col("rating"), F.col("review_count"), PARAMS)
    return best.select("venue_id", "source_key", "review_count", F.round(value, 9).alias("rating_score"))


def recency_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.recommendations(evidence(spark, sf_dir), TODAY, PARAMS)
    return rows.select("venue_id", F.round("recommendations", 6).alias("recommendations"))


DUCK_REC = f"""SELECT venue_id, sum(({RECENCY}) * confidence) AS recommendations FROM ({E})
WHERE independent AND confidence >= 0.5 GROUP BY venue_id"""


def category_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.category_pool(evidence(spark, sf_dir), category_table(spark, CATEGORIES))


DUCK_POOLS = "(VALUES ('1-URGENT','1-URGENT'),('2-HIGH','2-HIGH'),('3-MEDIUM','3-MEDIUM'),('4-NOT SPECIFIED','4-NOT SPECIFIED'),('4-NOT SPECIFIED','5-LOW'),('5-LOW','5-LOW')) p(category_key, found_by)"
DUCK_POOL = f"""SELECT p.category_key, s.venue_id, bool_or(p.category_key = p.found_by) AS own_query
FROM (SELECT DISTINCT venue_id, category_key AS found_by FROM ({S})) s JOIN {DUCK_POOLS} USING (found_by) GROUP BY 1, 2"""


def category_max_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = category_pool(spark, sf_dir).select("category_key", "venue_id")
    rec = scoring.recommendations(evidence(spark, sf_dir), TODAY, PARAMS)
    rows = scoring.share_of_maximum(pool.join(rec, "venue_id"), ["category_key"], "recommendations")
    return rows.select("category_key", "venue_id", F.round("recommendations", 6).alias("share"))


DUCK_SHARE = f"""SELECT category_key, venue_id, round(recommendations / max(recommendations) OVER (PARTITION BY category_key), 6) AS share
FROM ({DUCK_POOL}) JOIN ({DUCK_REC}) USING (venue_id)"""


# --- the whole score ---------------------------------------------------------------------------------
def venue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scores need of the sightings, one row per venue: recommendations, independent_sources, ratings (MAP source ->
    rating), keyword_hits (MAP category -> hits) and category_keys.

    The sightings are dealt once, by venue and slim; evidence, sources and venues are groups within groups, so every
    further step finds its rows in the same task and in the same order."""
    keys = sorted({k for c in CATEGORIES for k in (c.key, *c.pool_from)})  # configuration: a handful
    day = F.col("published_at").cast("date")
    seen = sightings(spark, sf_dir).select(
        "venue_id", "source_key", "url", day.alias("day"), "confidence", "independent", "rating", "review_count", "price", "quantity",
        F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("category_key")).cast("int").alias("list"), (F.col("query") == "P").alias("hit"),
    )
    seen = spread(seen, "venue_id")
    found, hits = [f"_found{i}" for i, _ in enumerate(keys)], [f"_hits{i}" for i, _ in enumerate(keys)]
    add = [F.sum(c).alias(c) for c in found + hits]
    # evidence: the surest sighting of a (venue, source, url), then the earliest; rating: the newest, then the dearest, then the largest
    surest = F.min(F.struct((-F.col("confidence")).alias("c"), F.coalesce("day", F.lit("9999-12-31").cast("date")).alias("day")))
    newest = F.struct(F.coalesce("day", F.lit("0001-01-01").cast("date")).alias("day"), "price", "quantity", "review_count", "rating")
    ev = seen.groupBy("venue_id", "source_key", "url").agg(
        surest.alias("s"), F.bool_or("independent").alias("independent"), F.max(newest).alias("r"),
        *[F.count_if(F.col("list") == i + 1).alias(c) for i, c in enumerate(found)],
        *[F.count_if((F.col("list") == i + 1) & F.col("hit")).alias(c) for i, c in enumerate(hits)],
    )
    dated = F.when(F.col("s.day") != F.lit("9999-12-31").cast("date"), F.col("s.day"))
    good = F.col("independent") & (-F.col("s.c") >= PARAMS.min_confidence)
    weight = F.when(good, scoring.recency(dated, TODAY, PARAMS) * -F.col("s.c"))
    by_source = ev.groupBy("venue_id", "source_key").agg(
        F.sum(weight).alias("w"), F.bool_or(good).alias("good"), F.max("r").alias("r"), *add
    )
    rate = F.struct("source_key", F.struct("r.rating", "r.review_count").alias("r"))
    facts = by_source.groupBy("venue_id").agg(
        F.sum("w").alias("recommendations"),
        F.array_sort(F.collect_list(F.when(F.col("good"), F.col("source_key")))).alias("independent_sources"),
        F.map_from_entries(F.array_sort(F.collect_list(rate))).alias("ratings"), *add,
    )
    names = F.array(*[F.lit(k) for k in keys])
    return facts.select(
        "venue_id", "recommendations", "independent_sources", "ratings",
        F.map_filter(F.map_from_arrays(names, F.array(*hits)), lambda _, n: n > 0).alias("keyword_hits"),
        F.array_compact(F.array(*[F.when(F.col(c) > 0, k) for c, k in zip(found, keys, strict=True)])).alias("category_keys"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in venue features: everything ``score_categories`` reads, one row per venue."""
    zero = F.lit(0).cast("long")
    return venues(spark, sf_dir).join(venue_facts(spark, sf_dir), "venue_id", "left").withColumns(
        {
            "quiet_hits": zero, "loud_hits": zero,
            "independent_count": F.size(F.coalesce("independent_sources", F.array())),
            "buzz": F.lit(None).cast("double"),
        }
    )


def scores(spark: SparkSession, sf_dir: str, hide_visited: bool = False) -> DataFrame:
    found = materialise(features(spark, sf_dir))
    table = category_table(spark, CATEGORIES)
    return scoring.score_categories(
        found, scoring.category_pool(found, table), table, weight_table(spark, CATEGORIES), TODAY, PARAMS, personal(spark, sf_dir),
        hide_visited,
    )


DUCK_CATEGORIES = """(VALUES
 ('1-URGENT', 2, true, false, NULL, false, NULL, NULL, false),
 ('2-HIGH', 5, false, false, 3, false, NULL, NULL, false),
 ('3-MEDIUM', 4, false, true, NULL, true, NULL, NULL, false),
 ('4-NOT SPECIFIED', 2, false, false, NULL, false, NULL, NULL, true),
 ('5-LOW', 4, false, false, NULL, false, 100, 400, false)
) c(category_key, party_size, need_weekends, need_halal, max_price_level, price_required, bill_low, bill_high, cheap_tier)"""
DUCK_REASON = """CASE
 WHEN my_status = 'excluded' THEN 'excluded by you'
 WHEN name LIKE '% plaza' OR name LIKE '% (closed)' THEN 'not a place to eat'
 WHEN business_status = 'CLOSED_PERMANENTLY' THEN 'closed permanently'
 WHEN need_weekends AND open_weekends = false THEN 'not open on weekends'
 WHEN need_halal AND NOT coalesce(halal, false) THEN 'not halal'
 WHEN price_level > max_price_level THEN 'price level ' || price_level || ' above ' || max_price_level
 WHEN price_required AND price_level IS NULL AND NOT (coalesce(michelin, '') IN ('Bib Gourmand', '1 Star', '2 Stars', '3 Stars', 'Star')) THEN 'no price level'
 WHEN cheap_tier AND name LIKE '% hotel' THEN 'hotel, not a cheap or affordable place'
 WHEN cheap_tier AND price_level IS NULL AND NOT own_query THEN 'no price level'
 WHEN cheap_tier AND price_level > 2 THEN 'price level ' || price_level || ' not in this tier'
 WHEN bill_low IS NOT NULL AND price_level IS NOT NULL AND NOT (bill BETWEEN bill_low AND bill_high)
   THEN 'estimated bill S$' || bill || ' outside S$100 to S$400' END"""
DUCK_POOLED = f"""SELECT *, {DUCK_REASON} AS excluded_reason FROM (
 SELECT v.*, c.*, own_query, CASE price_level WHEN 1 THEN 15 WHEN 2 THEN 35 WHEN 3 THEN 80 WHEN 4 THEN 160 END * party_size AS bill
 FROM ({DUCK_POOL}) p JOIN {DUCK_CATEGORIES} USING (category_key) JOIN ({V}) v USING (venue_id))"""


def hard_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = category_pool(spark, sf_dir)
    table = category_table(spark, CATEGORIES).drop("queries", "keywords", "pool")
    rows = pool.join(F.broadcast(table), "category_key").join(scoring.with_traits(venues(spark, sf_dir)), "venue_id")  # configuration
    rows = rows.join(personal(spark, sf_dir), "venue_id", "left")
    reason = F.when(F.col("status") == "excluded", "excluded by you").otherwise(
        scoring.hard_filter_reason(TODAY, PARAMS, F.col("own_query"))
    )
    return rows.select("category_key", "venue_id", reason.alias("excluded_reason"))


# weights per category after normalisation: rating, recommendations, keyword, food, weekend, award
_W = {c.key: c.merged_weights() for c in CATEGORIES}
_USED = ["rating", "recommendations", "keyword_match", "food", "weekend_open", "michelin"]


def _weight_rows() -> str:
    rows = []
    for key, w in _W.items():
        total = sum(w.values())
        rows.append(f"('{key}', " + ", ".join(f"CAST({w.get(c, 0.0) / total!r} AS DOUBLE)" for c in _USED) + ")")
    return "(VALUES " + ", ".join(rows) + ") w(category_key, w1, w2, w3, w4, w5, w6)"


DUCK_SCORED = f"""
WITH rows AS (
 SELECT b.*, r.recommendations AS rec_raw, {BAYES.replace("review_count", "q.review_count").replace("rating)", "q.rating)")} AS c1,
        coalesce(h.n, 0) AS hits, coalesce(i.n, 0) AS sources
 FROM ({DUCK_POOLED}) b
 LEFT JOIN ({DUCK_BEST}) q USING (venue_id)
 LEFT JOIN ({DUCK_REC}) r USING (venue_id)
 LEFT JOIN (SELECT venue_id, category_key, count(*) AS n FROM ({S}) WHERE query = 'P' GROUP BY 1, 2) h USING (venue_id, category_key)
 LEFT JOIN (SELECT venue_id, count(DISTINCT source_key) AS n FROM ({E}) WHERE independent AND confidence >= 0.5 GROUP BY 1) i USING (venue_id)
), comps AS (
 SELECT *, coalesce(rec_raw, 0) / nullif(max(CASE WHEN excluded_reason IS NULL THEN coalesce(rec_raw, 0) END) OVER (PARTITION BY category_key), 0) AS c2,
        CASE WHEN hits > 0 THEN ln(1 + hits) / ln(21) ELSE 0 END AS c3, food AS c4,
        CASE WHEN open_weekends THEN 1.0 WHEN NOT open_weekends THEN 0.0 END AS c5,
        CASE michelin WHEN 'Bib Gourmand' THEN 0.5 WHEN 'Star' THEN 0.7 WHEN '1 Star' THEN 0.7 WHEN '2 Stars' THEN 0.85 WHEN '3 Stars' THEN 1.0 END AS c6
 FROM rows
), summed AS (
 SELECT *, coalesce(c1 * w1, 0) + coalesce(c2 * w2, 0) + c3 * w3 + coalesce(c4 * w4, 0) + coalesce(c5 * w5, 0) + coalesce(c6 * w6, 0) AS top,
        CASE WHEN c1 IS NULL THEN 0 ELSE w1 END + w2 + w3 + CASE WHEN c4 IS NULL THEN 0 ELSE w4 END
        + CASE WHEN c5 IS NULL THEN 0 ELSE w5 END + CASE WHEN c6 IS NULL THEN 0 ELSE w6 END AS weight
 FROM comps JOIN {_weight_rows()} USING (category_key)
), adjusted AS (
 SELECT *, top / weight + CASE WHEN michelin IS NOT NULL THEN 0.03 ELSE 0 END + CASE WHEN sources >= 3 THEN 0.03 ELSE 0 END
   - CASE WHEN rating_trend = 'declining' THEN 0.05 ELSE 0 END - CASE WHEN hygiene_grade IN ('C', 'D') THEN 0.10 ELSE 0 END
   - CASE WHEN business_status = 'CLOSED_TEMPORARILY' THEN 0.50 ELSE 0 END AS raw
 FROM summed
)
SELECT category_key, venue_id, name, excluded_reason, my_status,
  CASE WHEN excluded_reason IS NOT NULL THEN 0
       ELSE greatest(0, least(1, CASE WHEN my_rating IS NOT NULL THEN 0.85 * raw + 0.15 * least(5, my_rating) / 5 ELSE raw END)) END AS score
FROM adjusted"""


def renormalised_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return rows.select("category_key", "venue_id", F.round("score", 6).alias("score"), "excluded_reason")


def rank_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: best 25 venues of every category, scored over all sightings."""
    rows = scores(spark, sf_dir).where("excluded_reason is null")
    order = [F.round("score", 6).desc(), F.col("name").asc(), F.col("venue_id").asc()]
    best = top_k(rows, ["category_key"], order, 25)
    return best.select("category_key", "rank", "venue_id", "name", F.round("score", 6).alias("score"))


def ranked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of every list; the maps of components and adjustments are not made where no report shows them."""
    rows = scores(spark, sf_dir, hide_visited=True)
    return scoring.rank_scores(rows.select("category_key", "venue_id", "name", F.round("score", 6).alias("score"), "excluded_reason", "hidden"))


def ranks_with_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_scores(spark, sf_dir).select("category_key", "venue_id", "rank", "hidden", "score")


def score_map_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores pivoted to one map per venue, flattened again for comparison."""
    rows = scores(spark, sf_dir).select(
        "category_key", "venue_id", F.round("score", 6).alias("score"), F.lit(1).alias("rank"), "excluded_reason", "hidden"
    )
    maps = serve.score_maps(rows)
    return maps.select("venue_id", F.size("scores").alias("lists"), F.explode("scores").alias("category_key", "s")).select(
        "venue_id", "lists", "category_key", F.col("s.score").alias("score")
    )


def rerank_sublists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stars list split into one tab per award."""
    v = venues(spark, sf_dir)
    ranked = row_numbers(
        v.where("michelin is not null").select("venue_id", "name"), [], [F.col("name").asc(), F.col("venue_id").asc()], "rank"
    )
    return serve.award_tabs(ranked, v).select("category_key", "venue_id", "rank")


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.evidence_summary(evidence(spark, sf_dir))
    return rows.select(
        "venue_id", F.array_join("source_keys", ",").alias("source_keys"),
        F.array_join("independent_sources", ",").alias("independent_sources"), F.array_join("category_keys", ",").alias("category_keys"),
    )


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir)
    return rows.select(
        "venue_id", "source_key", "url", "published_at", "confidence", "independent",
        F.array_join("category_keys", ",").alias("category_keys"), F.array_join("queries", ",").alias("queries"),
    )


def field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-value, last-value and preferred-source policies on the sighting order."""
    # every policy keeps an order of its own, and a task sees a few sightings of a venue: the sightings are dealt once, as numbers
    # and days where they can be, not the larger states of partial aggregates
    s = sightings(spark, sf_dir).select(
        "venue_id", F.col("published_at").cast("date").alias("published_at"), "rating", (F.col("source_key") == "src0").alias("main"),
        "run_id", (-F.col("confidence")).alias("c"), "order_no", "line_no", "price", "quantity",
    )
    s = spread(s, "venue_id").withColumns(
        {"published_at": F.col("published_at").cast("string"), "ord": F.struct("run_id", "c", "order_no", "line_no", "price", "quantity")}
    )
    main = F.col("main")
    return s.groupBy("venue_id").agg(
        merge.first_of(F.col("published_at")).alias("first_published"),
        merge.last_of(F.col("published_at")).alias("last_published"),
        F.round(merge.first_unless(F.col("rating"), main), 9).alias("rating"),
        F.min("published_at").alias("earliest_evidence"),
        F.min("run_id").alias("first_seen_run"), F.max("run_id").alias("last_seen_run"),
    )


_ORD = "{'a': run_id, 'b': -confidence, 'c': order_no, 'd': line_no, 'e': price, 'f': quantity}"
DUCK_FIELDS = f"""SELECT venue_id,
 arg_min(published_at, o) FILTER (published_at IS NOT NULL) AS first_published,
 arg_max(published_at, o) FILTER (published_at IS NOT NULL) AS last_published,
 round(coalesce(arg_max(rating, o) FILTER (source_key = 'src0'), arg_min(rating, o)), 9) AS rating,
 min(published_at) AS earliest_evidence, min(run_id) AS first_seen_run, max(run_id) AS last_seen_run
FROM (SELECT *, {_ORD} AS o FROM ({S})) GROUP BY venue_id"""


def run_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.run_profile(sightings(spark, sf_dir)).select("category_key", "source_key", "sightings", "names")


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five busiest sources per category."""
    counts = sightings(spark, sf_dir).groupBy("category_key", "source_key").agg(F.count(F.lit(1)).alias("sightings"))
    return top_k(counts, ["category_key"], [F.col("sightings").desc(), F.col("source_key").asc()], 5)


def ranked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).withColumn("rank", F.lit(1))
    return serve.ranked_counts(rows)


def bill_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placerank.functions.price import bill, price_symbol

    dims = category_table(spark, CATEGORIES).select("category_key", "party_size")
    rows = category_pool(spark, sf_dir).join(F.broadcast(dims), "category_key").join(venues(spark, sf_dir), "venue_id")  # configuration
    value = bill(F.col("price_level"), dict(PARAMS.per_pax), F.col("party_size"))
    return rows.select("category_key", "venue_id", price_symbol(F.col("price_level")).alias("price"), value.alias("bill"))


def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranked_scores(spark, sf_dir)
    rows = serve.category_report(ranked, venues(spark, sf_dir), category_table(spark, CATEGORIES), PARAMS)
    return rows.select("category_key", "section", "rank", "venue_id", "bill", "excluded_reason")


DUCK_RANKED = f"""SELECT *, CASE WHEN excluded_reason IS NULL AND NOT hidden THEN
  row_number() OVER (PARTITION BY category_key, excluded_reason IS NULL AND NOT hidden ORDER BY score DESC, name, venue_id) ELSE 0 END AS rank
 FROM (SELECT category_key, venue_id, name, excluded_reason, round(score, 6) AS score,
   excluded_reason IS NULL AND coalesce(my_status = 'visited', false) AS hidden FROM ({DUCK_SCORED}))"""
DUCK_REPORT = f"""SELECT r.category_key, CASE WHEN r.excluded_reason IS NOT NULL THEN 'excluded' WHEN hidden THEN 'hidden' WHEN rank <= 15 THEN 'top' ELSE 'rest' END AS section,
  rank, venue_id, CAST(CASE price_level WHEN 1 THEN 15 WHEN 2 THEN 35 WHEN 3 THEN 80 WHEN 4 THEN 160 END * party_size AS DOUBLE) AS bill, r.excluded_reason
FROM ({DUCK_RANKED}) r JOIN {DUCK_CATEGORIES} USING (category_key) JOIN ({V}) v USING (venue_id)"""


def wishlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = features(spark, sf_dir).select("venue_id", "name", "region", "price_level", "ratings")
    main = F.map_from_entries(F.array(F.struct(F.lit("google_places"), F.try_element_at("ratings", F.lit("src0")))))
    rows = serve.wishlist(personal(spark, sf_dir), maps.withColumn("ratings", main))
    return rows.select("venue_id", "name", "region", "price_level", F.round("google_rating", 6).alias("google_rating"))


def dashboard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranked_scores(spark, sf_dir)
    feats = features(spark, sf_dir).withColumn("district", F.lit(None).cast("string"))
    rows = serve.dashboard_table(feats, ranked, "2-HIGH", PARAMS)
    kept = rows.where(serve.dashboard_filter(["Central", "East"], budget=3, halal=True))
    return kept.select("venue_id", "rank", "name", "region", "price", "per_pax", "michelin", "status")


QUERIES = {
    "rank_by_category": (rank_by_category, f"""SELECT * FROM (SELECT category_key, row_number() OVER (PARTITION BY category_key ORDER BY round(score, 6) DESC, name, venue_id) AS rank,
        venue_id, name, round(score, 6) AS score FROM ({DUCK_SCORED}) WHERE excluded_reason IS NULL) WHERE rank <= 25"""),
    "bayesian_rating": (bayesian_rating, f"SELECT venue_id, source_key, review_count, round({BAYES}, 9) AS rating_score FROM ({DUCK_BEST})"),
    "recency_recommendations": (recency_recommendations, f"SELECT venue_id, round(recommendations, 6) AS recommendations FROM ({DUCK_REC})"),
    "category_pool": (category_pool, DUCK_POOL),
    "category_max_normalise": (category_max_normalise, DUCK_SHARE),
    "hard_filter_reasons": (hard_filter_reasons, f"SELECT category_key, venue_id, excluded_reason FROM ({DUCK_POOLED})"),
    "renormalised_score": (renormalised_score, f"SELECT category_key, venue_id, round(score, 6) AS score, excluded_reason FROM ({DUCK_SCORED})"),
    "ranks_with_hidden": (ranks_with_hidden, f"SELECT category_key, venue_id, rank, hidden, score FROM ({DUCK_RANKED})"),
    "score_map_per_entity": (score_map_per_entity, f"SELECT venue_id, count(*) OVER (PARTITION BY venue_id) AS lists, category_key, round(score, 6) AS score FROM ({DUCK_SCORED})"),
    "rerank_sublists": (rerank_sublists, f"""SELECT category_key, venue_id, row_number() OVER (PARTITION BY category_key ORDER BY name, venue_id) AS rank FROM (
        SELECT venue_id, name, CASE michelin WHEN '3 Stars' THEN 'michelin_3' WHEN '2 Stars' THEN 'michelin_2' WHEN '1 Star' THEN 'michelin_1' WHEN 'Star' THEN 'michelin_star' END AS category_key FROM ({V}))
        WHERE category_key IS NOT NULL"""),
    "evidence_merge": (evidence_merge, f"""SELECT venue_id, source_key, url, published_at, confidence, independent,
        array_to_string(category_keys, ',') AS category_keys, array_to_string(queries, ',') AS queries FROM ({E})"""),
    "evidence_summary": (evidence_summary, f"""SELECT venue_id, string_agg(DISTINCT source_key, ',' ORDER BY source_key) AS source_keys,
        coalesce(string_agg(DISTINCT source_key, ',' ORDER BY source_key) FILTER (independent AND confidence >= 0.5), '') AS independent_sources,
        (SELECT string_agg(DISTINCT category_key, ',' ORDER BY category_key) FROM ({S}) s WHERE s.venue_id = e.venue_id) AS category_keys
        FROM ({E}) e GROUP BY venue_id"""),
    "field_merge": (field_merge, DUCK_FIELDS),
    "run_profile": (run_profile, f"""SELECT category_key, source_key, count(*) AS sightings, count(DISTINCT lower(name)) AS names
        FROM ({S}) GROUP BY GROUPING SETS ((category_key, source_key), (category_key), ())"""),
    "top_sources": (top_sources, f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category_key ORDER BY sightings DESC, source_key) AS rank
        FROM (SELECT category_key, source_key, count(*) AS sightings FROM ({S}) GROUP BY 1, 2)) WHERE rank <= 5"""),
    "ranked_counts": (ranked_counts, f"SELECT category_key, count(*) AS ranked FROM ({DUCK_SCORED}) WHERE excluded_reason IS NULL GROUP BY 1"),
    "bill_estimates": (bill_estimates, f"""SELECT category_key, venue_id, repeat('$', price_level) AS price, CAST(bill AS DOUBLE) AS bill FROM ({DUCK_POOLED})"""),
    "category_report": (category_report, DUCK_REPORT),
    "wishlist": (wishlist, f"""SELECT v.venue_id, v.name, v.region, v.price_level, round(r.rating, 6) AS google_rating FROM ({V}) v
        LEFT JOIN (SELECT * FROM ({DUCK_RATINGS}) WHERE source_key = 'src0') r ON r.venue_id = v.venue_id WHERE v.my_status = 'wishlist'"""),
    "dashboard_table": (dashboard_table, f"""SELECT venue_id, rank, v.name, region, coalesce(repeat('$', price_level), '') AS price,
        CAST(CASE price_level WHEN 1 THEN 15 WHEN 2 THEN 35 WHEN 3 THEN 80 WHEN 4 THEN 160 END AS DOUBLE) AS per_pax, coalesce(michelin, '') AS michelin, business_status AS status
        FROM ({DUCK_RANKED}) r JOIN ({V}) v USING (venue_id) WHERE category_key = '2-HIGH' AND rank > 0 AND region IN ('Central', 'East')
        AND coalesce(price_level, 0) <= 3 AND halal AND business_status NOT LIKE 'CLOSED%'"""),
}
