import math

from pyspark.sql import functions as F

from placerank.operators import diff, enrich, validate
from placerank.plans import serve


def test_overlay_answers(spark):
    base = spark.sql("select 'a' venue_id, 3 texts, map('food', 0.5D, 'value', 0.4D) aspects, 'loud' noise_level, 's' summary, array('quiet') ambience_tags union all select 'b', 1, map('food', 0.5D), null, 's', array()")
    answers = spark.sql("select v venue_id, map('food', 0.9D) aspects, cast(null as string) noise_level, 'new' summary, array('Laksa') dishes, array('view', 'odd') tags from values ('a'), ('b') t(v)")
    rows = {r.venue_id: r for r in validate.overlay_answers(base, answers, ["view", "quiet"]).collect()}
    a, b = rows["a"], rows["b"]
    assert a.aspects == {"food": 0.9, "value": 0.4} and a.noise_level == "loud" and a.summary == "new"
    assert a.ambience_tags == ["quiet", "view"] and a.dishes == ["Laksa"]
    assert b.aspects == {"food": 0.5} and b.summary == "s" and b.dishes is None


def test_curated_list(spark):
    curated = spark.sql("select 'izakaya' list_key, 1 position, 'x001' venue_id, true site_only, 'Sake Den' name union all select 'izakaya', 2, 'v1', false, null union all select 'izakaya', 3, 'v9', false, null")
    site = spark.sql("select v venue_id, n name, array() cuisine, s summary, array('yakitori') dishes from values ('v1', 'Known', ''), ('v2', 'SAKE den', ''), ('v3', 'Robata Bar', ''), ('v4', 'Pizza', 'no') t(v, n, s)")
    finds = spark.sql("select v venue_id, r rank from values ('v1', 1), ('v2', 2), ('v3', 3) t(v, r)")
    rows = serve.curated_list(curated, finds, site, "izakaya|yakitori|robata").orderBy("rank").collect()
    assert [(r.rank, r.venue_id) for r in rows] == [(1, "x001"), (2, "v1"), (3, "v3")]


def test_geocode_prefers_the_exact_postal(spark):
    venues = spark.sql("select v venue_id, p postal_code, cast(null as double) lat, cast(null as double) lng from values ('a', '111111'), ('b', '222222'), ('c', null) t(v, p)")
    answers = spark.sql("select q query_postal, r result_postal, x lat, x lng, i position from values ('111111', '999999', 1.0D, 0), ('111111', '111111', 2.0D, 1) t(q, r, x, i)")
    rows = {r.venue_id: (r.lat, r.geocoded) for r in enrich.geocode(venues, answers).collect()}
    assert rows == {"a": (2.0, True), "b": (None, False), "c": (None, None)}


def test_nearest_station_equals_scan(spark):
    """Against all pairs, with places and stations without coordinates, near the poles and on both sides of the date line."""
    places = spark.range(60).select(F.col("id").cast("string").alias("venue_id"), (1.2 + F.col("id") * 7919 % 100 / 300).alias("lat"), (103.6 + F.col("id") * 104729 % 100 / 200).alias("lng"))
    far = [("e1", 10.0, 179.99), ("e2", 10.0, -179.99), ("e3", -17.0, 178.0), ("n", 89.9, 20.0), ("x", None, 5.0), ("y", 1.0, None)]
    places = places.union(spark.createDataFrame(far, "venue_id string, lat double, lng double"))
    stations = spark.range(20).select(F.concat(F.lit("s"), "id").alias("name"), (1.2 + F.col("id") * 31 % 17 / 50).alias("lat"), (103.6 + F.col("id") * 53 % 19 / 40).alias("lng"), F.array(F.lit("L")).alias("lines"))
    more = [("lost", None, None, None), ("half", 1.3, None, ["L"]), ("date", 10.0, -179.98, ["D"]), ("east", 10.0, 179.5, []), ("pole", 89.0, -160.0, ["P"])]
    stations = stations.union(spark.createDataFrame(more, "name string, lat double, lng double, lines array<string>"))
    want = {}
    for p in places.where("lat is not null and lng is not null").collect():
        for t in stations.where("lat is not null and lng is not null").collect():
            a, b, c, d = map(math.radians, (p.lat, p.lng, t.lat, t.lng))
            h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
            metres = 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))
            want[p.venue_id] = min(want.get(p.venue_id, (math.inf, "")), (metres, t.name))
    got = {r.venue_id: (r.metres, r.station) for r in enrich.nearest_station(places, stations).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1 + want[k][0] * 1e-4 for k in want) and got["e1"][1] == got["e2"][1] == "date"
    assert enrich.nearest_station(places, stations.limit(0)).count() == 0


def test_diff_of_a_run_with_itself_is_empty(spark):
    scores = spark.sql("select 'c' category_key, concat('v', id) venue_id, cast(id + 1 as int) rank, cast(null as string) excluded_reason, false hidden from range(5)")
    assert diff.list_churn(scores, scores, 3).isEmpty() and diff.rank_moves(scores, scores, 3).isEmpty()
    state = spark.sql("select 'v1' venue_id, 4.3D rating, cast(null as string) business_status")
    assert diff.rating_changes(state, state).isEmpty() and diff.status_changes(state, state).isEmpty()
    closed = spark.sql("select 'v1' venue_id, 4.6D rating, 'CLOSED_PERMANENTLY' business_status")
    assert diff.rating_changes(closed, state).first().delta == 0.3 and diff.status_changes(closed, state).first().change == "closed"


def test_search_page(spark):
    site = spark.sql("select 'v1' venue_id, 'Luna Bar' name, 'East' region, 3 price_level, true worth, false halal, cast(null as boolean) open_weekends, 'Michelin Star' michelin, false new, array('Bar') cuisine, 5 best_rank, 1.3D lat, 103.8D lng union all select 'v2', 'Sun Cafe', 'West', null, false, true, false, null, true, array('Cafe'), 1, null, null")
    ids = lambda **kw: [r.venue_id for r in serve.search_venues(site, **kw).collect()]
    assert ids() == ["v2", "v1"] and ids(query="east BAR") == ["v1"] and ids(max_price=2) == ["v2"]
    assert ids(weekend=True) == ["v1"] and ids(awarded=True) == ["v1"] and ids(near=(1.3, 103.8, 5.0)) == ["v1"]
