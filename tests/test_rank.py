import json

import pytest
from builders import sighting, sightings
from pyspark.sql import functions as F

from placerank.operators import scoring, text
from placerank.params import Category, ScoringParams
from placerank.plans import rank, serve, store
from placerank.schemas import EVIDENCE, REVIEW_SNIPPET, VENUE

TODAY = "2026-09-01"
ZICHAR = Category("zichar_family", "Zi char", "family", 5, keywords=("zi char", "cereal prawn"), open_weekends=True, weights={"space": 0.1})


def frame(spark, schema, rows):
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def venue(vid, name, rating, count, **kw):
    base = {
        "venue_id": vid, "name": name, "cuisine": [], "flags": {}, "ambience_tags": [], "open_weekends": True,
        "ratings": {"google_places": {"rating": rating, "review_count": count}}, "first_seen_run": "r1", "last_seen_run": "r1",
    }
    return {**base, **kw}


def proof(vid, source, url, date, snippet=None):
    return {
        "venue_id": vid, "source_key": source, "url": url, "published_at": date, "snippet": snippet, "confidence": 1.0,
        "independent": True, "category_keys": ["zichar_family"], "queries": ["q"],
    }


@pytest.fixture(scope="module")
def scored(spark):
    from placerank.operators.merge import Registry

    venues = frame(spark, VENUE, [
        venue("v1", "Strong", 4.6, 2000, michelin="Bib Gourmand", flags={"good_for_groups": True}),
        venue("v2", "Tiny", 4.9, 12),
        venue("v3", "Closed", 5.0, 500, business_status="CLOSED_PERMANENTLY"),
        venue("v4", "Weekday Only", 4.8, 900, open_weekends=False),
        venue("v5", "Dirty", 4.6, 2000, hygiene_grade="C"),
        venue("v6", "Excluded", 4.9, 5000),
        venue("v7", "Visited", 4.7, 3000),
    ])
    evidence = frame(spark, EVIDENCE, [
        proof("v1", "sethlui", "u1", "2026-06-01", "best zi char cereal prawn"), proof("v1", "eatbook", "u2", "2026-05-01"),
        proof("v1", "michelin", "u3", "2026-01-01"), proof("v2", "burpple", "u4", "2026-08-01", "zi char"),
        proof("v5", "sethlui", "u5", "2026-06-01"), proof("v7", "sethlui", "u7", "2026-08-01"),
        *[proof(v, "blog", "x" + v, "2026-08-01") for v in ("v3", "v4", "v6")],
    ])
    reg = Registry(venues, venues.select("venue_id", F.col("name").alias("alias")), evidence, frame(spark, REVIEW_SNIPPET, []))
    history = spark.createDataFrame([("v2", "2026-01-01", 4.95), ("v2", "2026-06-01", 4.7)], "venue_id string, date string, rating double").withColumn("date", F.col("date").cast("date"))
    features = rank.venue_features(reg, [ZICHAR], TODAY, ScoringParams(), history=history)
    personal = spark.createDataFrame([("v6", "excluded", None), ("v7", "visited", 5.0)], "venue_id string, status string, my_rating double")
    return features, rank.rank_venues(features, evidence, [ZICHAR], TODAY, personal=personal, hide_visited=True)


def test_category_scores(scored):
    by = {r.venue_id: r for r in scored[1].collect()}
    assert by["v3"].excluded_reason == "closed permanently"
    assert by["v4"].excluded_reason == "not open on weekends"
    assert by["v6"].excluded_reason == "excluded by you"
    assert by["v1"].rank == 1 and by["v1"].adjustments["michelin"] == 0.03 and by["v1"].adjustments["multi_source"] == 0.03
    assert by["v1"].score > by["v2"].score
    assert by["v2"].adjustments["declining_trend"] == -0.05
    assert by["v5"].adjustments["poor_hygiene"] == -0.10 and by["v5"].score < by["v1"].score
    assert by["v7"].hidden and by["v7"].rank == 0 and by["v7"].adjustments["personal"] == 0.15
    visible = sorted(r.rank for r in by.values() if not r.excluded_reason and not r.hidden)
    assert visible == list(range(1, len(visible) + 1))
    v1 = by["v1"]
    assert sum(v1.components.values()) == pytest.approx(v1.score - sum(v1.adjustments.values()))


def test_reports_and_exports(spark, scored, tmp_path):
    from placerank.params import category_table

    features, scores = scored
    dims = category_table(spark, [ZICHAR])
    csv = serve.category_export(scores, features, dims, ScoringParams())
    store.write_category_csvs(csv, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 7 and back.where("rank = '1'").first()["name"] == "Strong"
    report = {r.venue_id: r for r in serve.venue_report(features, scores, dims, ScoringParams()).collect()}
    assert report["v1"].ranks == {"zichar_family": 1} and report["v3"].exclusions[0].excluded_reason == "closed permanently"
    merged = {r.venue_id: json.loads(r.json) for r in serve.merged_export(features, scores).collect()}
    assert merged["v1"]["scores"]["zichar_family"]["rank"] == 1
    line = features.where("venue_id = 'v1'").withColumn("nearest_mrt", F.lit("Bugis")).select(serve.summary_sentence({"sethlui": "Seth"}).alias("s")).first().s
    assert line.startswith("Strong is a restaurant, near Bugis MRT. It is recommended by 3 independent sources, holds a Michelin Bib Gourmand and rated 4.6 on Google over 2,000 reviews.")
    cats = dims.withColumn("position", F.lit(0))
    best = serve.best_category(scores.where("rank > 0").select("venue_id", "category_key", "rank"), features, cats)
    phrase = features.join(best, "venue_id").where("venue_id = 'v1'").select(serve.best_for_phrase(F.col("category_key"), F.col("category_group")).alias("p")).first().p
    assert phrase == "a no-fuss zi char dinner with the family"


def test_bayesian_and_recency(spark):
    p = ScoringParams()
    df = spark.createDataFrame([(4.6, 2000, "2026-09-01"), (4.9, 12, "2020-01-01"), (None, 5, None)], "r double, n int, d string").withColumn("d", F.col("d").cast("date"))
    rows = df.select(scoring.bayesian(F.col("r"), F.col("n"), p).alias("b"), scoring.recency(F.col("d"), TODAY, p).alias("w")).collect()
    assert rows[0].b == pytest.approx(0.8952, abs=1e-4) and rows[1].b == pytest.approx(0.8188, abs=1e-4) and rows[2].b is None
    assert [r.w for r in rows] == [1.0, 0.05, 0.5]


def test_text_features(spark):
    texts = spark.createDataFrame(
        [("a", "the food was delicious and the prawns were fresh. service was slow though, we waited ages."),
         ("a", "beautiful cosy ambience but very noisy on weekends. prices are reasonable, worth it."),
         ("a", "portion not generous. staff were friendly."), ("b", "quiet corner, peaceful"), ("c", "romantic date night, very romantic")],
        "venue_id string, text string",
    )
    scores = {r.venue_id: r.aspects for r in text.aspect_scores(texts).collect()}
    assert scores["a"]["food"] > 0.6 and scores["a"]["service"] < 0.6 and scores["a"]["value"] > 0.6
    assert set(scores["a"]) == {"food", "service", "ambience", "value"}
    levels = {r.venue_id: r.l for r in text.noise_counts(texts).select("venue_id", text.noise_level(F.col("quiet_words"), F.col("loud_words")).alias("l")).collect()}
    assert levels == {"a": "loud", "b": "quiet", "c": None}
    totals = text.keyword_totals(texts.where("venue_id = 'c'"), ["romantic", "date night", "kids"])
    assert {r.keyword: r.hits for r in totals.collect()} == {"romantic": 2, "date night": 1}


@pytest.mark.parametrize(
    "history, reviews, want",
    [
        ([], [], "unknown"),
        ([], [(5.0, "2026-08-01"), (5.0, "2026-07-01"), (4.0, "2025-12-01")], "improving"),
        ([], [(3.0, "2026-08-01"), (3.0, "2026-07-01"), (4.0, "2026-06-01")], "declining"),
        ([("2026-01-01", 4.3), ("2026-06-01", 4.0)], [(5.0, "2026-08-01")] * 3, "declining"),
        ([("2026-01-01", 4.3), ("2026-06-01", 4.35)], [], "stable"),
    ],
)
def test_rating_trend(spark, history, reviews, want):
    h = spark.createDataFrame([("v", d, r) for d, r in history], "venue_id string, date string, rating double").withColumn("date", F.col("date").cast("date"))
    s = spark.createDataFrame([("v", r, d) for r, d in reviews], "venue_id string, rating double, published_at string")
    o = spark.createDataFrame([("v", 4.3)], "venue_id string, overall double")
    assert text.rating_trend(h, s, o, TODAY).first().rating_trend == want


def test_rank_run_end_to_end(spark):
    src = spark.createDataFrame([("sethlui", True), ("burpple", True)], "source_key string, independent boolean")
    rows = [
        sighting("google_places", "Keng Eng Kee Seafood", source_ref="p1", postal_code="150124", rating=4.5, review_count=900),
        sighting("sethlui", "Keng Eng Kee Seafood", postal_code="150124", snippet="best zi char in town", extra={"published_at": "2026-08-01"}),
        sighting("burpple", "Ah Hua Kitchen", postal_code="310123"),
    ]
    done = rank.rank_run(sightings(spark, rows), src, [Category("zichar_family", "Zi char", "family", 5)], TODAY)
    ranks = {r.name: r.rank for r in done.scores.collect()}
    assert ranks == {"Keng Eng Kee Seafood": 1, "Ah Hua Kitchen": 2} and done.next_id == 3
