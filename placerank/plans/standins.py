"""Venue-shaped views over the driver's test tables, in SQL that Spark and DuckDB both run.

The ranking operators need sightings, venues and mentions; the test tables hold orders, parts and
events.  Each view derives one from the other, row by row, so its size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.params import Category, ScoringParams
from placerank.session import spread

TODAY = "2001-12-01"
MENTIONS_TODAY = "2024-02-01"
SPLIT_DAY = "2024-01-16"
TABLES = (
    "region nation customer supplier part orders lineitem events documents pages conversations"
).split()


SIGHTINGS = """
SELECT 'v' || lpad(CAST(l.l_partkey AS STRING), 8, '0') AS venue_id,
       p.p_name || ' ' || p.p_brand AS name,
       'src' || CAST(l.l_suppkey % 8 AS STRING) AS source_key,
       'https://src' || CAST(l.l_suppkey % 8 AS STRING) || '.test/' || CAST(l.l_orderkey % 50 AS STRING) AS url,
       o.o_orderpriority AS category_key,
       o.o_orderstatus AS query,
       round(1 - 5 * l.l_discount, 2) AS confidence,
       1 + 4 * (l.l_quantity - 1) / 49 AS rating,
       CAST(l.l_orderkey % 3000 AS INT) AS review_count,
       CASE WHEN l.l_linenumber <> 7 THEN CAST(CAST(l.l_shipdate AS DATE) AS STRING) END AS published_at,
       l.l_suppkey % 8 < 6 AS independent,
       CASE WHEN CAST(l.l_shipdate AS DATE) < DATE '1999-01-01' THEN '19990101T000000Z' ELSE '20011201T000000Z' END AS run_id,
       l.l_extendedprice AS price, l.l_quantity AS quantity, l.l_orderkey AS order_no,
       l.l_linenumber AS line_no
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey
"""

VENUES = """
SELECT 'v' || lpad(CAST(p_partkey AS STRING), 8, '0') AS venue_id,
       p_name || ' ' || p_brand || CASE p_partkey % 97 WHEN 0 THEN ' plaza' WHEN 1 THEN ' hotel' WHEN 2 THEN ' (closed)' ELSE '' END AS name,
       lpad(CAST(p_partkey * 37 % 1000000 AS STRING), 6, '0') AS postal_code,
       CASE p_partkey % 4 WHEN 0 THEN 'Central' WHEN 1 THEN 'East' WHEN 2 THEN 'West' END AS region,
       CASE WHEN p_partkey % 9 <> 0 THEN CAST(1 + p_size % 4 AS INT) END AS price_level,
       CASE p_partkey % 23 WHEN 0 THEN 'CLOSED_PERMANENTLY' WHEN 1 THEN 'CLOSED_TEMPORARILY' ELSE 'OPERATIONAL' END AS business_status,
       CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS open_weekends,
       CASE p_partkey % 31 WHEN 0 THEN 'Bib Gourmand' WHEN 1 THEN '1 Star' WHEN 2 THEN '2 Stars' WHEN 3 THEN '3 Stars' WHEN 4 THEN 'Star' WHEN 5 THEN 'Selected' END AS michelin,
       CASE p_partkey % 17 WHEN 0 THEN 'C' WHEN 1 THEN 'A' END AS hygiene_grade,
       CASE WHEN p_partkey % 3 = 0 THEN true END AS halal,
       CASE WHEN p_partkey % 7 = 0 THEN true END AS private_room,
       CASE p_partkey % 11 WHEN 0 THEN true WHEN 1 THEN false END AS kid_friendly,
       CASE WHEN p_size % 3 <> 0 THEN p_size / CAST(50 AS DOUBLE) END AS food,
       CASE p_partkey % 13 WHEN 0 THEN 'declining' WHEN 1 THEN 'improving' ELSE 'unknown' END AS rating_trend,
       lower(p_type) AS type_label,
       1.2E0 + (p_partkey * 7919 % 1000) / CAST(4000 AS DOUBLE) AS lat,
       1.036E2 + (p_partkey * 104729 % 1000) / CAST(2000 AS DOUBLE) AS lng,
       CASE p_partkey % 41 WHEN 0 THEN 'excluded' WHEN 1 THEN 'visited' WHEN 2 THEN 'wishlist' END AS my_status,
       CASE WHEN p_partkey % 19 = 0 THEN CAST(p_partkey % 6 AS DOUBLE) END AS my_rating,
       CASE WHEN p_partkey % 29 = 0 THEN '20011125T000000Z' ELSE '20010101T000000Z' END AS first_seen_run,
       p_retailprice AS retail_price, p_size AS size, p_partkey AS part_no
FROM {part}
"""

MENTIONS = """
SELECT user_id AS venue_no, 'm' || CAST(user_id AS STRING) AS venue_id,
       'u' || CAST(event_id % 4000 AS STRING) AS url, event_type AS platform,
       CASE WHEN event_id % 10 <> 3 THEN CAST(CAST(ts AS DATE) AS STRING) END AS post_date,
       event_id AS arrival, value, ts,
       CASE WHEN CAST(ts AS DATE) < DATE '2024-01-16' THEN 'run1' ELSE 'run2' END AS run_id
FROM {events}
"""

PLACES = """
SELECT 'c' || CAST(c_custkey AS STRING) AS venue_id, c_name AS name, c_mktsegment AS region,
       1.2E0 + (c_custkey * 7919 % 1000) / CAST(4000 AS DOUBLE) AS lat,
       1.036E2 + (c_custkey * 104729 % 1000) / CAST(2000 AS DOUBLE) AS lng,
       lpad(CAST(c_custkey * 61 % 830000 AS STRING), 6, '0') AS postal_code,
       c_acctbal AS balance, c_nationkey AS nation_no
FROM {customer}
"""

STATIONS = """
SELECT n_name AS name, 1.2E0 + (n_nationkey * 7919 % 1000) / CAST(4000 AS DOUBLE) AS lat,
       1.036E2 + (n_nationkey * 104729 % 1000) / CAST(2000 AS DOUBLE) AS lng
FROM {nation}
"""

LOWERED = "SELECT doc_id, lower(coalesce(text, '')) AS text, source, n_chars FROM {documents}"

# Runs: event types are lists, users are venues, ranked by their total value in each half.
RUN_SCORES = """
SELECT run_id, platform AS category_key, venue_id, round(sum(value), 4) AS score
FROM ({mentions}) m GROUP BY run_id, platform, venue_id
"""


def duck(sql: str, **views: str) -> str:
    """The SQL with plain table names, for DuckDB."""
    return sql.format(**{t: t for t in TABLES}, **views)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the parquet tables of ``sf_dir``; only the tables it names are opened."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SIGHTINGS)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MENTIONS)


def evidence(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """Sightings merged to one row per (venue, source, url), as the merge does it."""
    s = sightings(spark, sf_dir) if seen is None else seen
    order = F.struct(
        (-F.col("confidence")).alias("c"), F.coalesce("published_at", F.lit("9999")).alias("p")
    )
    first = F.min_by(F.struct("published_at", "confidence"), order)
    return (
        s.groupBy("venue_id", "source_key", "url")
        .agg(
            first.alias("f"),
            F.array_sort(F.collect_set("category_key")).alias("category_keys"),
            F.array_sort(F.collect_set("query")).alias("queries"),
            F.bool_or("independent").alias("independent"),
        )
        .select("venue_id", "source_key", "url", "f.published_at", "f.confidence", "category_keys", "queries", "independent")
    )


DUCK_EVIDENCE = """
SELECT venue_id, source_key, url,
       arg_min(published_at_, o) AS pub, min(c) AS neg_conf, -min(c) AS confidence,
       list_sort(list(DISTINCT category_key)) AS category_keys, list_sort(list(DISTINCT query)) AS queries,
       bool_or(independent) AS independent
FROM (SELECT *, -confidence AS c, coalesce(published_at, '9999') AS published_at_,
             {{'a': -confidence, 'b': coalesce(published_at, '9999')}} AS o FROM ({sightings}))
GROUP BY venue_id, source_key, url
"""


def duck_evidence() -> str:
    inner = DUCK_EVIDENCE.format(sightings=duck(SIGHTINGS))
    return f"SELECT *, nullif(pub, '9999') AS published_at FROM ({inner})"


CATEGORIES = [
    Category("1-URGENT", "Urgent", "dating", 2, open_weekends=True),
    Category("2-HIGH", "High", "family", 5, max_price_level=3, weights={"value": 0.0, "food": 0.2}),
    Category("3-MEDIUM", "Medium", "general", 4, halal_only=True, price_required=True),
    Category("4-NOT SPECIFIED", "Unspecified", "general", 2, price_levels=(1, 2), pool_from=("5-LOW",), digest_only=True),
    Category("5-LOW", "Low", "general", 4, bill_range=(100.0, 400.0), weights={"michelin": 0.1}),
]
PARAMS = ScoringParams()


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue rows with the map and array columns the operators expect."""
    v = spread(view(spark, sf_dir, VENUES), "part_no")
    keys = ["halal", "private_room", "kid_friendly"]
    flags = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*keys))
    return v.withColumns(
        {
            "flags": F.map_filter(flags, lambda _, x: x.isNotNull()),
            "aspects": F.map_filter(F.create_map(F.lit("food"), F.col("food")), lambda _, x: x.isNotNull()),
            "ambience_tags": F.array().cast("array<string>"),
            "cuisine": F.array("type_label"),
            "summary": F.lit(None).cast("string"),
            "parking": F.lit(None).cast("string"),
            "name_zh": F.lit(None).cast("string"),
            "earliest_evidence": F.lit(None).cast("string"),
        }
    ).drop(*keys, "food", "my_status", "my_rating")


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, VENUES).select("venue_id", F.col("my_status").alias("status"), "my_rating")
    return rows.where("status is not null or my_rating is not null")
