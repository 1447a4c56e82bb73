"""Registered queries against DuckDB on the smallest tables, and the plan properties they rely on."""

import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from placerank.operators.ordered import fill_forward, row_numbers, running_sums  # noqa: E402
from placerank.plans.standins import TABLES  # noqa: E402

SOME = [
    "recency_recommendations", "hard_filter_reasons", "field_merge", "run_profile", "buzz_scores", "mention_upsert",
    "rank_moves", "cards_to_send", "valid_promos", "keyword_counts", "aspect_scores", "page_links", "listicle_entries",
    "jsonld_listings", "extract_names", "opening_hours", "nearest_station", "exact_match_tiers",
]


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "is_finite"):
        v = float(v)
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    res = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert table(df.columns, df.collect()) == table(res.columns, res.fetchall())


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    from placerank.plans.standins import sightings

    df = sightings(spark, sf_dir).where(F.col("order_no") < 100).select("venue_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "PushedFilters: [IsNotNull(l_orderkey), LessThan(l_orderkey,100)" in plan


def test_ordered_scans_with_a_hot_group(spark):
    rows = [("hot", i, float(i % 7), None if i % 5 else i) for i in range(400)] + [("cold", i, 1.0, None) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, i int, v double, r int").repartition(5)
    ranks = {(r.g, r.i): r.rank for r in row_numbers(df, ["g"], [F.col("i").desc()]).collect()}
    assert ranks == {**{("hot", i): 400 - i for i in range(400)}, **{("cold", i): 20 - i for i in range(20)}}
    sums = {(r.g, r.i): r.s for r in running_sums(df, ["g"], [F.col("i").asc()], "v", "s").collect()}
    assert sums["hot", 399] == sum(i % 7 for i in range(400)) and sums["hot", 10] == sum(i % 7 for i in range(11))
    filled = {(r.g, r.i): r.f for r in fill_forward(df, ["g"], ["i"], "r", "f").collect()}
    assert all(filled["hot", i] == i - i % 5 for i in range(400)) and filled["cold", 3] is None


def test_field_merge_deals_sightings_not_states(spark, sf_dir):
    """One exchange by venue, and it comes before any aggregate."""
    plan = queries()["field_merge"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    lines = [line for line in plan.splitlines() if "hashpartitioning(venue_id" in line or "Aggregate" in line]
    dealt = [i for i, line in enumerate(lines) if "hashpartitioning(venue_id" in line]
    assert dealt == [len(lines) - 1] and len(lines) > 1


def test_venue_facts_deal_sightings_once_and_equal_the_operators(spark, sf_dir):
    from placerank.operators import merge, scoring
    from placerank.plans.ranking_queries import features, ratings
    from placerank.plans.standins import PARAMS, TODAY, evidence, sightings

    rows = features(spark, sf_dir)
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("hashpartitioning(venue_id") == 2  # sightings and venues, each dealt once
    got = {r.venue_id: r for r in rows.collect()}
    ev = evidence(spark, sf_dir)
    recommended = {r.venue_id: r.recommendations for r in scoring.recommendations(ev, TODAY, PARAMS).collect()}
    assert {v for v, r in got.items() if r.recommendations is not None} == set(recommended)
    assert all(math.isclose(got[v].recommendations, x, rel_tol=1e-12) for v, x in recommended.items())
    for r in merge.evidence_summary(ev).collect():
        assert got[r.venue_id].independent_sources == r.independent_sources and sorted(got[r.venue_id].category_keys) == r.category_keys
    rated = {(v, s, *x) for v, r in got.items() for s, x in (r.ratings or {}).items()}
    assert rated == {tuple(r) for r in ratings(spark, sf_dir).select("venue_id", "source_key", "rating", "review_count").collect()}
    hits = sightings(spark, sf_dir).where("query = 'P'").groupBy("venue_id", "category_key").count().collect()
    assert {(v, k, n) for v, r in got.items() for k, n in (r.keyword_hits or {}).items()} == {tuple(r) for r in hits}


def test_reports_rank_without_maps(spark, sf_dir):
    from placerank.plans.ranking_queries import ranked_scores

    assert not {"components", "adjustments"} & set(ranked_scores(spark, sf_dir).columns)
