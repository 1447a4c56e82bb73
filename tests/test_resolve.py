from builders import RUN, sighting, sightings
from pyspark.sql import functions as F

from placerank.operators import merge, resolve

PRAISE = {"rating": 4, "published_at": "2026-02-11T09:30:00Z", "snippet": "Candlelit corner, the broth is worth it", "social_words": 0}
LANTERN = [
    # one noodle house seen in seven ways, a bakery in two, a tea room alone, and two rows that find nothing
    sighting("google_places", "Lantern Street Noodles", source_ref="id-lantern", postal_code="238801", phone="+65 6733 1000", rating=4.6,
             review_count=310, price_level=2, address="9 Lantern Street, Singapore 238801",
             opening_hours={"weekday_descriptions": ["Tuesday: 12:00 – 9:00 PM", "Sunday: 12:00 – 6:00 PM"]},
             extra={"allows_dogs": True, "reviews": [PRAISE]}),
    sighting("google_places", "Lantern St. Noodle House", source_ref="id-lantern", rating=4.6, review_count=310, category="supper"),
    sighting("plate_notes", "Lantern Street Noodles", postal_code="238801", booking_url="https://book.test/lantern", extra={"published_at": "2026-01-20"}),
    sighting("table_desk", "The Lantern", booking_url="https://book.test/lantern", confidence=0.8),
    sighting("ring_list", "Noodles by Lantern", phone="+65 6733 1000"),
    sighting("plate_notes", "LANTERN STREET NOODLES", snippet="a romantic supper"),
    sighting("fork_map", "Lantern Street Noodle", postal_code="238801"),
    sighting("fork_map", "Crumb & Ember", postal_code="428802"),
    sighting("plate_notes", "Crumb & Ember", postal_code="428802", extra={"published_at": "2025-12-01"}),
    sighting("fork_map", "Jade Kettle Tea Room", postal_code="079903"),
    sighting("chatter", "Unheard Of Counter", confidence=0.3),
    sighting("register", "Somebody Else Pte Ltd", postal_code="609904", hygiene_grade="B", confidence=0.0, extra={"enrich_only": True}),
]


def sources(spark):
    return spark.createDataFrame([(k, k != "ring_list") for k in ("plate_notes", "fork_map", "ring_list", "chatter")], "source_key string, independent boolean")


def test_every_tier(spark):
    done = resolve.resolve(sightings(spark, LANTERN))
    got = [(r.venue_id, r.method) for r in done.assignments.orderBy("seq").collect()]
    noodles = got[0][0]
    assert [m for v, m in got if v == noodles] == ["created", "place_id", "name_postal", "booking_link", "phone", "name_exact", "fuzzy_name"]
    assert [m for _, m in got[7:]] == ["created", "name_postal", "created", "none", "none"]
    assert got[7][0] == got[8][0] != got[9][0] and len({v for v, _ in got if v}) == 3 and done.next_id == 4
    weak = {(r.merged_name, r.method) for r in resolve.merge_log(done.assignments).collect()}
    assert weak == {("The Lantern", "booking_link"), ("Noodles by Lantern", "phone"), ("Lantern Street Noodle", "fuzzy_name")}
    stats = {r.method: r.sightings for r in resolve.match_stats(done.assignments).collect()}
    assert stats["created"] == 3 and stats["none"] == 2

    reg = merge.build_registry(done.assignments, sources(spark))
    venue = reg.venues.where(F.col("venue_id") == noodles).first()
    assert (venue.name, venue.postal_code, venue.price_level) == ("Lantern Street Noodles", "238801", 2)
    assert [[h.open, h.close] for h in venue.hours["tue"]] == [["12:00", "21:00"]] and venue.open_weekends is True
    assert venue.ratings["google_places"].review_count == 310 and venue.earliest_evidence == "2026-01-20" and venue.ambience_tags == ["romantic"]
    assert reg.reviews.where(F.col("venue_id") == noodles).count() == 1
    aliases = {r.alias for r in reg.names.where(F.col("venue_id") == noodles).collect()}
    assert {"The Lantern", "Noodles by Lantern"} <= aliases
    summary = merge.evidence_summary(reg.evidence).where(F.col("venue_id") == noodles).first()
    assert summary.independent_sources == ["fork_map", "plate_notes"]

    known = resolve.known_keys(reg.venues, reg.names)
    later = sightings(spark, [sighting("fork_map", "Jade Kettle Tea Room", postal_code="079903")], "20260908T000000Z")
    again = resolve.resolve(later, known, done.next_id)
    assert [(r.venue_id, r.method) for r in again.assignments.collect()] == [(got[9][0], "name_postal")] and again.next_id == 4
    both = merge.merge_venues(done.assignments.unionByName(again.assignments)).where(F.col("venue_id") == got[9][0]).first()
    assert (both.first_seen_run, both.last_seen_run) == (RUN, "20260908T000000Z")


def test_identical_sightings_create_once(spark):
    row = sighting("fork_map", "Twice Told Grill", postal_code="238801")
    base = sightings(spark, [row, row, row]).withColumn("seq", F.lit(0))
    methods = sorted(r.method for r in resolve.resolve(base).assignments.collect())
    assert methods == ["created", "name_postal", "name_postal"]


def test_a_late_claim_does_not_hide_an_earlier_one(spark):
    """The older entity has the name since 10, the younger since 5: a lookup at 7 finds the younger one."""
    index = spark.createDataFrame(
        [("A", None, "lantern", "238801", None, None, 10, 1), ("B", None, "lantern", "238801", None, None, 5, 2), ("C", None, "lantern", "238801", None, None, 6, 3)],
        "entity string, place_id string, name_key string, postal string, phone string, booking string, since long, entity_ord long",
    )
    rows = spark.createDataFrame(
        [(7, None, "lantern", "238801", None, None, 7), (11, None, "lantern", "238801", None, None, 11), (5, None, "lantern", "238801", None, None, 5)],
        "node long, place_id string, name_key string, postal string, phone string, booking string, ord long",
    )
    got = {r.node: r.entity for r in resolve.match_exact(rows, index).collect()}
    assert got == {7: "B", 11: "A"}
    queries = rows.select(F.col("node").alias("query_id"), "name_key", "postal", "ord", F.lit(False).alias("catalogue"))
    near = {r.query_id: r.entity for r in resolve.fuzzy_matches(queries, index.select("entity", "name_key", "postal", "since", "entity_ord"), 88, 90).collect()}
    assert near == {7: "B", 11: "A"}


def test_fuzzy_needs_compatible_postal(spark):
    rows = [
        sighting("sethlui", "Ah Hua Zi Char", postal_code="310123"),
        sighting("eatbook", "Ah Hua Zichar", postal_code="460999"),
        sighting("burpple", "Ah Hua Zichar"),
    ]
    done = resolve.resolve(sightings(spark, rows))
    got = [(r.venue_id, r.method) for r in done.assignments.orderBy("seq").collect()]
    assert got == [("v00001", "created"), ("v00002", "created"), ("v00002", "name_exact")]


def test_phone_relink(spark):
    rows = [
        sighting("sethlui", "Cafe A", postal_code="160056"),
        sighting("burpple", "Cafe A", phone="+65 6220 3430", postal_code="160056"),
        sighting("eatbook", "Kafe A", phone="+65 6220 3430"),
    ]
    done = resolve.resolve(sightings(spark, rows))
    got = [(r.venue_id, r.method) for r in done.assignments.orderBy("seq").collect()]
    assert got == [("v00001", "created"), ("v00001", "name_postal"), ("v00001", "phone")]
    assert [r.method for r in resolve.merge_log(done.assignments).collect()] == ["phone"]


def test_attach_only_rows_help_each_other(spark):
    rows = [
        sighting("sethlui", "Luna Rooftop", postal_code="160056", phone="+65 6220 3430"),
        sighting("reddit", "The Moon Spot", phone="+65 6220 3430", confidence=0.4),
        sighting("reddit", "Moon Spot", confidence=0.3),
        sighting("reddit", "Nowhere", confidence=0.3),
    ]
    done = resolve.resolve(sightings(spark, rows))
    got = [(r.venue_id, r.method) for r in done.assignments.orderBy("seq").collect()]
    assert got == [("v00001", "created"), ("v00001", "phone"), ("v00001", "name_exact"), (None, "none")]


def test_catalogue_rows_need_a_close_name(spark):
    rows = [
        sighting("sethlui", "Golden Dragon Palace Hall", postal_code="160056"),
        sighting("sfa", "Golden Dragon Palazzo Hall", postal_code="160056", confidence=0.0, extra={"enrich_only": True}),
        sighting("sethlui", "Silver Phoenix Garden Hall", postal_code="160057"),
        sighting("reddit", "Silver Phoenix Gardin Hall", confidence=0.45),
    ]
    done = resolve.resolve(sightings(spark, rows))
    got = {r.seq: r.method for r in done.assignments.collect()}
    assert got == {0: "created", 1: "none", 2: "created", 3: "fuzzy_name"}


def test_result_does_not_depend_on_partitioning(spark):
    base = sightings(spark, LANTERN)
    one = resolve.resolve(base.repartition(1)).assignments
    many = resolve.resolve(base.repartition(7, F.rand(3))).assignments
    key = lambda df: sorted((r.seq, r.venue_id or "", r.method) for r in df.collect())
    assert key(one) == key(many)


def test_tables_carried_on_hold_numbers_for_nodes(spark, monkeypatch):
    """What a run writes decides its disk: a node and its place in the order are eight bytes, not a digest and a struct."""
    kept = []
    for name in ("materialise", "settle"):
        cut = getattr(resolve, name)
        monkeypatch.setattr(resolve, name, lambda df, cut=cut: kept.append(df.dtypes) or cut(df))
    done = resolve.resolve(sightings(spark, LANTERN), fuzzy=False)
    assert done.assignments.where("venue_id is not null").count() == 10
    assert kept and not [t for t in kept for _, kind in t if kind == "binary" or "seq:bigint" in kind]


def test_sightings_of_one_ord_and_name_are_one_venue(spark):
    """Rows that differ by their phones alone have one place in the order; one of them still comes first."""
    rows = [sighting("fork_map", "Twice Told Grill", postal_code="238801", phone=p) for p in ("+65 6733 1000", "+65 6733 2000", None)]
    base = sightings(spark, rows).withColumn("seq", F.lit(0))
    got = sorted((r.venue_id, r.method) for r in resolve.resolve(base, fuzzy=False).assignments.collect())
    assert got == [("v00001", "created"), ("v00001", "name_postal"), ("v00001", "name_postal")]
