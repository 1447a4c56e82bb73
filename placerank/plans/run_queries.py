"""Registered queries over mentions (events), runs and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.operators import diff, social, text
from placerank.operators.ordered import fill_forward, row_numbers, running_sums, top_k
from placerank.plans.standins import (
    MENTIONS,
    MENTIONS_TODAY,
    SIGHTINGS,
    VENUES,
    duck,
    mentions,
    sightings,
    venues,
    view,
)

M = duck(MENTIONS)
TOP = 20


# --- buzz and mentions -----------------------------------------------------------------------------
def buzz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = social.buzz_scores(mentions(spark, sf_dir), MENTIONS_TODAY)
    return rows.select(
        "venue_id", "mentions_window", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"), "trending",
        F.col("latest").cast("string").alias("latest"),
    )


DUCK_BUZZ = f"""WITH once AS (
  SELECT venue_id, url, arg_min(coalesce(post_date, ''), arrival) AS d FROM ({M}) GROUP BY 1, 2
), raw AS (
  SELECT venue_id, count(*) AS mentions_window, max(nullif(d, '')) AS latest,
    sum(CASE WHEN d = '' THEN CAST(0.25 AS DOUBLE) ELSE pow(CAST(0.5 AS DOUBLE), (DATE '{MENTIONS_TODAY}' - CAST(nullif(d, '') AS DATE)) / CAST(60 AS DOUBLE)) END) AS raw
  FROM once WHERE d = '' OR CAST(nullif(d, '') AS DATE) >= DATE '{MENTIONS_TODAY}' - 182 GROUP BY 1
)
SELECT venue_id, mentions_window, round(raw, 6) AS raw, round(raw / (SELECT max(raw) FROM raw), 6) AS score, mentions_window >= 5 AS trending, latest FROM raw"""


def recent_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = social.recent_mentions(mentions(spark, sf_dir), 8)
    return rows.select("venue_id", "rank", "url", "platform", "post_date", "arrival")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = mentions(spark, sf_dir).select(
        social.mention_key(F.col("platform"), F.col("url"), F.lit(None).cast("string")).alias("key"),
        F.when(F.col("arrival") % 3 > 0, F.col("venue_id")).alias("venue_id"),
        F.when(F.col("arrival") % 3 > 0, F.lit("handle")).otherwise("unmatched").alias("matched_by"),
        F.when(F.col("arrival") % 5 > 0, F.concat(F.lit("caption "), F.col("url"))).alias("caption"),
        "arrival", "run_id",
    )
    latest = lambda run: social.latest_mentions(m.where(F.col("run_id") == run), ["arrival"])
    return latest("run1"), latest("run2")


def mention_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _halves(spark, sf_dir)
    rows = social.upsert_mentions(stored, incoming)
    return rows.select(F.replace("key", F.lit("\u0001"), F.lit("|")).alias("key"), "venue_id", "matched_by", "caption", "arrival", "change")


DUCK_HALF = f"""SELECT platform || '|' || url || '|' AS key, max(arrival) AS arrival,
  arg_max(CASE WHEN arrival % 3 > 0 THEN venue_id ELSE '' END, arrival) AS v, arg_max(CASE WHEN arrival % 5 > 0 THEN 'caption ' || url ELSE '' END, arrival) AS c
  FROM ({M}) WHERE run_id = 'RUN' GROUP BY 1"""
DUCK_UPSERT = f"""WITH s AS ({DUCK_HALF.replace("RUN", "run1")}), i AS ({DUCK_HALF.replace("RUN", "run2")}),
j AS (SELECT coalesce(s.key, i.key) AS key, s.arrival AS sa, i.arrival AS ia, s.v AS sv, i.v AS iv, s.c AS sc, i.c AS ic,
  CASE WHEN s.key IS NULL THEN 'new' WHEN i.key IS NULL THEN 'kept'
       WHEN (i.v <> '' AND s.v <> i.v) OR (s.c = '' AND i.c <> '') THEN 'updated' ELSE 'kept' END AS change
  FROM s FULL JOIN i ON s.key = i.key)
SELECT key, nullif(CASE WHEN change = 'kept' THEN sv ELSE iv END, '') AS venue_id,
  CASE WHEN (CASE WHEN change = 'kept' THEN sv ELSE iv END) = '' THEN 'unmatched' ELSE 'handle' END AS matched_by,
  nullif(CASE WHEN change = 'kept' THEN sc ELSE ic END, '') AS caption, CASE WHEN change = 'kept' THEN sa ELSE ia END AS arrival, change FROM j"""


def new_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir).withColumn("creator_handle", F.lit(None).cast("string"))
    return diff.new_mentions(m, "run2").select("url", "platform", "venue_id", "post_date")


# --- ordered scans ---------------------------------------------------------------------------------
def carry_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value of an event type that carries one, per user over time."""
    e = view(spark, sf_dir, "SELECT user_id, event_id, ts, CASE WHEN event_type = 'click' THEN value END AS reading FROM {events}")
    return fill_forward(e, ["user_id"], ["ts", "event_id"], "reading", "filled").select("user_id", "event_id", "filled")


def running_budget_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest documents per source while their lengths (plus one each) stay within a budget."""
    d = view(spark, sf_dir, "SELECT doc_id, source, length(text) + 1 AS size FROM {documents}")
    total = running_sums(d, ["source"], [F.col("doc_id").desc()], "size", "used")
    return total.where("used <= 20000").select("source", "doc_id", "used")


def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every event within its type, in time order (distributed row_number)."""
    e = view(spark, sf_dir, "SELECT event_type, event_id, ts FROM {events}")
    return row_numbers(e, ["event_type"], [F.col("ts").asc(), F.col("event_id").asc()], "position").drop("ts")


def rating_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of a user's event values: own daily history, else recent against overall."""
    e = view(spark, sf_dir, "SELECT user_id AS venue_id, CAST(ts AS DATE) AS date, value / 100 AS rating, event_type, event_id, CAST(CAST(ts AS DATE) AS STRING) AS published_at FROM {events}")
    history = e.where("event_type = 'purchase' and event_id % 2 = 0").groupBy("venue_id", "date").agg(F.max("rating").alias("rating"))
    overall = e.groupBy("venue_id").agg(F.round(F.avg("rating"), 6).alias("overall"))
    recent = e.where("event_type = 'view'")
    history = history.where(F.col("venue_id") % 3 > 0)
    stretched = history.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), (F.date_diff("date", F.lit("2024-01-01").cast("date")) * 2).cast("int")))
    return text.rating_trend(stretched, recent, overall, MENTIONS_TODAY)


DUCK_TREND = f"""WITH e AS (SELECT user_id AS venue_id, CAST(ts AS DATE) AS d, value / 100 AS rating, event_type, event_id FROM events),
h AS (SELECT venue_id, d, max(rating) AS rating FROM e WHERE event_type = 'purchase' AND event_id % 2 = 0 AND venue_id % 3 > 0 GROUP BY 1, 2),
own AS (SELECT venue_id, arg_min(rating, d) AS f, arg_max(rating, d) AS l, (max(d) - min(d)) * 2 AS span FROM h GROUP BY 1),
o AS (SELECT venue_id, round(avg(rating), 6) AS overall FROM e GROUP BY 1),
r AS (SELECT venue_id, avg(rating) AS recent, count(*) AS n FROM e WHERE event_type = 'view' AND DATE '{MENTIONS_TODAY}' - d <= 365 GROUP BY 1)
SELECT venue_id, CASE WHEN span >= 30 THEN CASE WHEN l - f >= 0.1 THEN 'improving' WHEN l - f <= -0.1 THEN 'declining' ELSE 'stable' END
  WHEN n >= 3 THEN CASE WHEN recent - overall >= 0.3 THEN 'improving' WHEN recent - overall <= -0.3 THEN 'declining' ELSE 'stable' END
  ELSE 'unknown' END AS rating_trend FROM o LEFT JOIN own USING (venue_id) LEFT JOIN r USING (venue_id)"""


# --- two runs ----------------------------------------------------------------------------------------
def _run_scores(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    """Top part of every list of a run: users by total value per event type."""
    m = mentions(spark, sf_dir).where(F.col("run_id") == run)
    totals = m.groupBy(F.col("platform").alias("category_key"), "venue_id").agg(F.round(F.sum("value"), 4).alias("score"))
    order = [F.col("score").desc(), F.col("venue_id").asc()]
    return row_numbers(totals, ["category_key"], order, "rank").withColumns(
        {"excluded_reason": F.lit(None).cast("string"), "hidden": F.lit(False)}
    )


def _duck_run(run: str) -> str:
    return f"""(SELECT category_key, venue_id, row_number() OVER (PARTITION BY category_key ORDER BY score DESC, venue_id) AS rank FROM
      (SELECT platform AS category_key, venue_id, round(sum(value), 4) AS score FROM ({M}) WHERE run_id = '{run}' GROUP BY 1, 2))"""


R1, R2 = _duck_run("run1"), _duck_run("run2")


def run_list_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.list_churn(_run_scores(spark, sf_dir, "run2"), _run_scores(spark, sf_dir, "run1"), TOP)


DUCK_MOVES = f"""SELECT category_key, venue_id, CASE WHEN b.rank IS NULL THEN 'entered' WHEN a.rank IS NULL THEN 'left' WHEN a.rank < b.rank THEN 'moved up' WHEN a.rank > b.rank THEN 'moved down' END AS change,
  a.rank AS rank, b.rank AS prev_rank FROM (SELECT * FROM {R2} WHERE rank <= {TOP}) a FULL JOIN (SELECT * FROM {R1} WHERE rank <= {TOP}) b USING (category_key, venue_id)"""


def rank_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.rank_moves(_run_scores(spark, sf_dir, "run2"), _run_scores(spark, sf_dir, "run1"), TOP)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue state per run: mean value as rating, a status from the last event."""
    m = mentions(spark, sf_dir)
    return m.groupBy("run_id", "venue_id").agg(
        # whole cents: the sum is exact in any order
        (F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 2000).alias("rating"),
        F.when(F.max("arrival") % 3 == 0, "CLOSED_TEMPORARILY").otherwise("OPERATIONAL").alias("business_status"),
    )


DUCK_STATES = f"""(SELECT run_id, venue_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 2000 AS rating, CASE WHEN max(arrival) % 3 = 0 THEN 'CLOSED_TEMPORARILY' ELSE 'OPERATIONAL' END AS status
  FROM ({M}) GROUP BY 1, 2)"""


def rating_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    before = diff.baseline(s, "run2")
    rows = diff.rating_changes(s.where("run_id = 'run2'"), before, 0.2)
    return rows.withColumn("delta", F.round("delta", 2))


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    return diff.status_changes(s.where("run_id = 'run2'"), diff.baseline(s, "run2"))


def new_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir).select("run_id", "venue_id", F.concat("platform", F.lit("/"), F.col("arrival") % 7).alias("source_key"))
    rows = diff.new_sources(m.where("run_id = 'run2'"), m.where("run_id = 'run1'"))
    return rows.select("venue_id", F.array_join("sources", ",").alias("sources"))


def new_and_lost_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir).groupBy(F.concat("venue_id", F.lit("/"), "url").alias("venue_id")).agg(
        F.min("run_id").alias("first_seen_run"), F.max("run_id").alias("last_seen_run"), F.min("platform").alias("name")
    )
    fresh = diff.new_venues(
        m.withColumn("region", F.lit(None).cast("string")),
        mentions(spark, sf_dir).select(F.concat("venue_id", F.lit("/"), "url").alias("venue_id"), F.col("platform").alias("category_key")),
        "run2",
    )
    lost = m.where("last_seen_run = 'run1'")
    return fresh.select("venue_id", F.lit("new").alias("change"), F.array_join("categories", ",").alias("categories")).union(
        lost.select("venue_id", F.lit("lost"), F.lit(None).cast("string"))
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _run_scores(spark, sf_dir, "run2"), _run_scores(spark, sf_dir, "run1")
    churn = diff.list_churn(now, before, TOP)
    fresh = now.select("venue_id").distinct().join(before.select("venue_id").distinct(), "venue_id", "left_anti")
    return diff.change_feed(churn, before, fresh, 12)


DUCK_FEED = f"""WITH moves AS ({DUCK_MOVES}), e AS (SELECT venue_id, 0 AS part, category_key, rank FROM moves WHERE change = 'entered'),
n AS (SELECT DISTINCT venue_id, 1 AS part, venue_id AS category_key, 0 AS rank FROM {R2} WHERE venue_id NOT IN (SELECT venue_id FROM {R1})),
o AS (SELECT venue_id, min({{'a': part, 'b': category_key, 'c': rank}}) AS place FROM (SELECT * FROM e UNION ALL SELECT * FROM n) GROUP BY 1)
SELECT venue_id, CASE WHEN place.a = 0 THEN place.b END AS category_key, CASE WHEN place.a = 0 THEN place.c END AS rank FROM o ORDER BY place LIMIT 12"""


def _labels(spark: SparkSession) -> DataFrame:
    rows = [("view", "Views", False), ("click", "Clicks", False), ("purchase", "Purchases", False), ("error", "Errors", True), ("signup", "Signups", False)]
    return spark.createDataFrame(rows, "category_key string, label string, digest_only boolean")


def cards_to_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card per venue newly on top or newly listed, without those already sent at these ranks."""
    now, before = _run_scores(spark, sf_dir, "run2"), _run_scores(spark, sf_dir, "run1")
    fresh = now.select("venue_id").distinct().join(before.select("venue_id").distinct(), "venue_id", "left_anti")
    rows = diff.cards(now, before, _labels(spark), fresh, TOP)
    number = F.regexp_extract("venue_id", r"(\d+)", 1).cast("long")
    sent = rows.where(number % 4 == 0).select("venue_id", "ranks", F.lit("2024-01-10").alias("sent_at"))
    return diff.unsent(rows, sent).select("venue_id", "ranks", "best_rank", "lists", "is_new")


DUCK_CARDS = f"""WITH l(category_key, label) AS (VALUES ('view','Views'),('click','Clicks'),('purchase','Purchases'),('signup','Signups')),
e AS (SELECT category_key, venue_id, rank FROM ({DUCK_MOVES}) WHERE change = 'entered'),
t AS (SELECT category_key, venue_id, rank FROM {R2} a WHERE rank <= 3 AND NOT EXISTS (SELECT 1 FROM {R1} b WHERE b.rank <= 3 AND b.category_key = a.category_key AND b.venue_id = a.venue_id)),
p AS (SELECT DISTINCT * FROM (SELECT * FROM e UNION ALL SELECT * FROM t) JOIN l USING (category_key)),
g AS (SELECT venue_id, string_agg('#' || rank || ' · ' || label, '; ' ORDER BY rank, label) AS ranks, min(rank) AS best_rank, count(*) AS lists FROM p GROUP BY 1),
n AS (SELECT DISTINCT venue_id FROM {R2} WHERE venue_id NOT IN (SELECT venue_id FROM {R1}))
SELECT coalesce(g.venue_id, n.venue_id) AS venue_id, coalesce(ranks, 'new') AS ranks, coalesce(best_rank, 99) AS best_rank, coalesce(lists, 0) AS lists, n.venue_id IS NOT NULL AS is_new
FROM g FULL JOIN n ON g.venue_id = n.venue_id WHERE CAST(substr(coalesce(g.venue_id, n.venue_id), 2) AS BIGINT) % 4 <> 0"""


def best_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best rank, number of lists and all ranks of every venue."""
    from placerank.plans.serve import rank_index

    index = rank_index(_run_scores(spark, sf_dir, "run2"), _labels(spark))
    return index.select("venue_id", "best_rank", "lists", diff.ranks_key(F.col("ranks")).alias("ranks"))


DUCK_INDEX = f"""SELECT venue_id, min(rank) AS best_rank, count(*) AS lists, string_agg('#' || rank || ' · ' || label, '; ' ORDER BY rank, label) AS ranks
FROM {R2} JOIN (VALUES ('view','Views'),('click','Clicks'),('purchase','Purchases'),('error','Errors'),('signup','Signups')) l(category_key, label) USING (category_key) GROUP BY 1"""


def list_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placerank.plans.serve import group_counts

    groups = spark.createDataFrame([("looking", "view"), ("looking", "click"), ("buying", "purchase"), ("all", "view"), ("all", "purchase")], "group_key string, category_key string")
    return group_counts(_run_scores(spark, sf_dir, "run2"), groups)


def registry_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked venues of run 2 with their row of run 2, or of run 1 when run 2 has none."""
    from placerank.plans.serve import with_backfill

    s = _states(spark, sf_dir)
    number = F.regexp_extract("venue_id", r"(\d+)", 1).cast("long")
    current = s.where((F.col("run_id") == "run2") & (number % 3 > 0))
    ids = _run_scores(spark, sf_dir, "run2").select("venue_id").distinct()
    return with_backfill(current, s.where("run_id = 'run1'"), ids).select("venue_id", "run_id", "rating")


def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run before run2 among the runs the mentions belong to."""
    runs = mentions(spark, sf_dir).select("run_id").distinct().withColumns({"status": F.lit("ok"), "scored": F.lit(True)})
    return diff.previous_run(runs, "run2")


def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked dates of users: those active in run 2 take the new date."""
    m = mentions(spark, sf_dir)
    stored = m.where("run_id = 'run1'").groupBy(F.col("venue_id").alias("name")).agg(F.max("post_date").alias("checked"))
    answered = m.where("run_id = 'run2' and arrival % 11 = 0").select(F.col("venue_id").alias("name"), F.lit("2024-02-01").alias("checked"))
    return diff.upsert_state(stored, answered)


def rolling_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling weekly cap on distinct tags per account; decisions follow time order."""
    m = mentions(spark, sf_dir)
    rows = m.select(F.concat(F.lit("account"), F.col("venue_no") % 10).alias("account"), F.col("arrival").alias("request_id"), F.concat("platform", F.col("arrival") % 9).alias("tag"), F.col("ts").cast("timestamp").alias("at"))
    return social.capped_tags(rows, cap=25, days=7).select("account", "request_id", "tag", "outcome")


DUCK_CAP = f"""WITH RECURSIVE q AS (SELECT 'account' || (venue_no % 10) AS account, arrival AS request_id, platform || (arrival % 9) AS tag, CAST(ts AS TIMESTAMP) AS t FROM ({M})),
n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY t, request_id, tag) AS i FROM q),
r AS (SELECT DISTINCT account, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(tag VARCHAR, t TIMESTAMP)[]) AS live FROM q
  UNION ALL SELECT account, request_id, tag, CASE WHEN again THEN 'repeat' WHEN len(kept) < 25 THEN 'accepted' ELSE 'rejected' END, i,
    CASE WHEN again OR len(kept) < 25 THEN list_append(list_filter(kept, lambda x: x.tag <> used.tag), used) ELSE kept END
  FROM (SELECT *, len(list_filter(kept, lambda x: x.tag = used.tag)) > 0 AS again FROM (
    SELECT n.account, n.request_id, n.tag, n.i, {{'tag': n.tag, 't': n.t}} AS used, list_filter(r.live, lambda x: x.t >= n.t - INTERVAL 7 DAY) AS kept FROM r JOIN n ON n.account = r.account AND n.i = r.i + 1)))
SELECT account, request_id, tag, outcome FROM r WHERE i > 0"""


def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placerank.plans.serve import recent_activity as recent

    m = mentions(spark, sf_dir).select("arrival", "venue_id", F.col("ts").cast("timestamp").alias("at"))
    return recent(m, "2024-01-30").select("arrival", "venue_id")


# --- queues and promotions -----------------------------------------------------------------------------
def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placerank.plans.serve import tracked_names

    rows = [("view", 1, False), ("click", 2, False), ("purchase", 3, True), ("error", 4, False), ("signup", 5, False)]
    dims = spark.createDataFrame(rows, "category_key string, position int, digest_only boolean")
    ranked = _run_scores(spark, sf_dir, "run2")
    named = ranked.select("venue_id", F.concat(F.lit("User "), "venue_id").alias("name")).distinct()
    return tracked_names(ranked, named, dims)


DUCK_TRACKED = f"""SELECT 'User ' || venue_id AS name, min({{'a': p, 'b': rank}}) AS place FROM {R2}
  JOIN (VALUES ('view',1,8),('click',2,8),('purchase',3,12),('error',4,8),('signup',5,8)) d(category_key, p, n) USING (category_key) WHERE rank <= n GROUP BY 1"""


def promo_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked(spark, sf_dir)


def recheck_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placerank.plans.serve import recheck_queue as queue

    m = mentions(spark, sf_dir)
    user = F.concat(F.lit("User "), "venue_id")
    checked = m.where("run_id = 'run1' and arrival % 7 = 0").groupBy(user.alias("name")).agg(F.max("post_date").alias("checked"))
    closed = m.where("arrival % 400 = 3").select(user.alias("name")).distinct()
    return queue(_tracked(spark, sf_dir), checked, closed)


DUCK_QUEUE = f"""SELECT name, checked FROM ({DUCK_TRACKED}) t
  LEFT JOIN (SELECT 'User ' || venue_id AS name, max(post_date) AS checked FROM ({M}) WHERE run_id = 'run1' AND arrival % 7 = 0 GROUP BY 1) c USING (name)
  WHERE name NOT IN (SELECT 'User ' || venue_id FROM ({M}) WHERE arrival % 400 = 3) ORDER BY checked NULLS FIRST, place LIMIT 24"""


def valid_promos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers derived from sightings: deals for parts, some unasked, some over, some without https."""
    from placerank.operators.validate import valid_promos as valid

    s = sightings(spark, sf_dir)
    scheme = F.when(F.col("order_no") % 5 == 0, "http://").otherwise("https://")
    answers = s.select(
        F.upper("venue_id").alias("name"),
        F.concat(F.when(F.col("line_no") == 1, " Festive set ").otherwise("Set "), F.col("quantity").cast("int"), F.lit(" ")).alias("deal"),
        F.when(F.col("line_no") == 2, F.lit("soon")).otherwise(F.col("published_at")).alias("ends"),
        F.concat(scheme, F.lit("x.test/"), F.col("order_no")).alias("url"),
        F.struct("order_no", "line_no", "price", "quantity", "published_at").alias("position"),
    )
    asked = venues(spark, sf_dir).where("part_no % 3 = 0").select(F.col("venue_id").alias("name"))
    return valid(answers, asked, "2000-01-01").select("name", "deal", "ends", "url", "festive")


S, V = duck(SIGHTINGS), duck(VENUES)
DUCK_PROMOS = f"""WITH a AS (SELECT s.venue_id AS name, trim(CASE WHEN line_no = 1 THEN ' Festive set ' ELSE 'Set ' END || CAST(quantity AS INT)) AS deal, line_no = 1 AS festive,
   CASE WHEN line_no = 2 THEN NULL ELSE published_at END AS ends, 'https://x.test/' || order_no AS url,
   {{'a': order_no, 'b': line_no, 'c': price, 'd': quantity, 'e': coalesce(published_at, '')}} AS o
  FROM ({S}) s JOIN ({V}) v USING (venue_id) WHERE v.part_no % 3 = 0 AND order_no % 5 <> 0)
SELECT name, arg_min(deal, o) AS deal, nullif(arg_min(coalesce(ends, ''), o), '') AS ends, arg_min(url, o) AS url, arg_min(festive, o) AS festive
FROM a WHERE ends IS NULL OR ends >= '2000-01-01' GROUP BY name"""


def hide_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without hidden names; names carry list bullets that the comparison ignores."""
    from placerank.plans.serve import hide_listed as visible

    v = venues(spark, sf_dir)
    bulleted = v.select("venue_id", F.concat(F.lit("· "), "name", F.lit(" -")).alias("name"))
    hidden = v.where("part_no % 6 = 1").select("name")
    scores = sightings(spark, sf_dir).groupBy("category_key", "venue_id").agg(F.count(F.lit(1)).alias("n"))
    return visible(scores, bulleted, hidden)


def top_n_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    totals = m.groupBy(F.col("platform").alias("category_key"), "venue_id").agg(F.round(F.sum("value"), 4).alias("score"))
    return top_k(totals, ["category_key"], [F.col("score").desc(), F.col("venue_id").asc()], 15)


QUERIES = {
    "buzz_scores": (buzz_scores, DUCK_BUZZ),
    "recent_mentions": (recent_mentions, f"""SELECT * FROM (SELECT venue_id, row_number() OVER (PARTITION BY venue_id ORDER BY post_date DESC NULLS LAST, arrival) AS rank, url, platform, post_date, arrival FROM ({M})) WHERE rank <= 8"""),
    "mention_upsert": (mention_upsert, DUCK_UPSERT),
    "new_mentions": (new_mentions, f"SELECT url, platform, venue_id, post_date FROM ({M}) WHERE run_id = 'run2'"),
    "carry_forward_fill": (carry_forward_fill, """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events"""),
    "running_budget_take": (running_budget_take, """SELECT * FROM (SELECT source, doc_id, sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000"""),
    "event_positions": (event_positions, "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events"),
    "rating_trend": (rating_trend, DUCK_TREND),
    "run_list_churn": (run_list_churn, f"SELECT * FROM ({DUCK_MOVES}) WHERE change IN ('entered', 'left')"),
    "rank_moves": (rank_moves, f"SELECT * FROM ({DUCK_MOVES}) WHERE change IS NOT NULL"),
    "rating_changes": (rating_changes, f"""SELECT venue_id, b.rating AS "from", a.rating AS "to", round(a.rating - b.rating, 2) AS delta FROM (SELECT * FROM {DUCK_STATES} WHERE run_id = 'run2') a
        JOIN (SELECT * FROM {DUCK_STATES} WHERE run_id = 'run1') b USING (venue_id) WHERE abs(a.rating - b.rating) >= 0.2"""),
    "status_changes": (status_changes, f"""SELECT venue_id, CASE WHEN a.status LIKE 'CLOSED%' THEN 'closed' ELSE 'reopened' END AS change, a.status FROM (SELECT * FROM {DUCK_STATES} WHERE run_id = 'run2') a
        JOIN (SELECT * FROM {DUCK_STATES} WHERE run_id = 'run1') b USING (venue_id) WHERE a.status <> b.status"""),
    "new_sources": (new_sources, f"""WITH m AS (SELECT run_id, venue_id, platform || '/' || (arrival % 7) AS s FROM ({M})) SELECT venue_id, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM m
        WHERE run_id = 'run2' AND venue_id IN (SELECT venue_id FROM m WHERE run_id = 'run1') AND (venue_id, s) NOT IN (SELECT (venue_id, s) FROM m WHERE run_id = 'run1') GROUP BY 1"""),
    "new_and_lost_entities": (new_and_lost_entities, f"""WITH g AS (SELECT venue_id || '/' || url AS venue_id, min(run_id) AS a, max(run_id) AS b, string_agg(DISTINCT platform, ',' ORDER BY platform) AS c FROM ({M}) GROUP BY 1)
        SELECT venue_id, 'new' AS change, c AS categories FROM g WHERE a = 'run2' UNION ALL SELECT venue_id, 'lost', NULL FROM g WHERE b = 'run1'"""),
    "change_feed": (change_feed, DUCK_FEED),
    "cards_to_send": (cards_to_send, DUCK_CARDS),
    "best_ranks": (best_ranks, DUCK_INDEX),
    "list_group_counts": (list_group_counts, f"""SELECT group_key, count(DISTINCT venue_id) AS places FROM {R2} JOIN (VALUES ('looking','view'),('looking','click'),('buying','purchase'),('all','view'),('all','purchase')) g(group_key, category_key) USING (category_key)
        GROUP BY 1"""),
    "registry_backfill": (registry_backfill, f"""WITH c AS (SELECT * FROM {DUCK_STATES} WHERE run_id = 'run2' AND CAST(substr(venue_id, 2) AS BIGINT) % 3 > 0), o AS (SELECT * FROM {DUCK_STATES} WHERE run_id = 'run1')
        SELECT venue_id, run_id, rating FROM c UNION ALL SELECT venue_id, run_id, rating FROM o WHERE venue_id NOT IN (SELECT venue_id FROM c) AND venue_id IN (SELECT venue_id FROM {R2})"""),
    "previous_run": (previous_run, f"SELECT max(run_id) AS run_id FROM ({M}) WHERE run_id < 'run2'"),
    "state_upsert": (state_upsert, f"""WITH s AS (SELECT venue_id AS name, max(post_date) AS c FROM ({M}) WHERE run_id = 'run1' GROUP BY 1), a AS (SELECT DISTINCT venue_id AS name, '2024-02-01' AS n FROM ({M}) WHERE run_id = 'run2' AND arrival % 11 = 0)
        SELECT coalesce(s.name, a.name) AS name, coalesce(n, c) AS checked FROM s FULL JOIN a ON s.name = a.name"""),
    "rolling_cap": (rolling_cap, DUCK_CAP),
    "recent_activity": (recent_activity, f"SELECT arrival, venue_id FROM ({M}) WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'"),
    "promo_targets": (promo_targets, f"SELECT name, place.a AS list, place.b AS rank FROM ({DUCK_TRACKED})"),
    "recheck_queue": (recheck_queue, DUCK_QUEUE),
    "valid_promos": (valid_promos, DUCK_PROMOS),
    "hide_listed": (hide_listed, f"SELECT category_key, venue_id, count(*) AS n FROM ({S}) s JOIN ({V}) v USING (venue_id) WHERE v.name NOT IN (SELECT name FROM ({V}) WHERE part_no % 6 = 1) GROUP BY 1, 2"),
    "top_n_per_category": (top_n_per_category, f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category_key ORDER BY score DESC, venue_id) AS rank FROM
        (SELECT platform AS category_key, venue_id, round(sum(value), 4) AS score FROM ({M}) GROUP BY 1, 2)) WHERE rank <= 15"""),
}
