"""Schemas of the stored tables."""

from __future__ import annotations

REVIEW = "struct<rating:double,published_at:string,snippet:string,social_words:int>"

# One sighting: a place seen in one source for one query, not yet deduplicated.
SIGHTING = f"""
    run_id string, source_key string, category_key string, category_group string, party_size int,
    query string, page_url string, source_ref string, name string, name_zh string, brand string,
    address string, postal_code string, lat double, lng double, phone string, website string,
    booking_url string, rating double, review_count int, price_level int, price_text string,
    cuisine array<string>,
    opening_hours struct<weekday_descriptions:array<string>,text:string>,
    business_status string, michelin string, hygiene_grade string, snippet string,
    confidence double,
    extra struct<enrich_only:boolean,published_at:string,thread_created_utc:double,
        article_title:string,thread_title:string,reviews:array<{REVIEW}>,
        good_for_children:boolean,good_for_groups:boolean,outdoor_seating:boolean,
        wheelchair_accessible_entrance:boolean,reservable:boolean,serves_vegetarian_food:boolean,
        allows_dogs:boolean,google_maps_uri:string>,
    captured_at string, seq long
"""

PAGE = "source_key string, url string, title string, published_at string, content_hash string, run_id string"

RUN_EVENT = "run_id string, at timestamp, level string, component string, message string"

HOURS = "map<string,array<struct<open:string,close:string>>>"

# One canonical place.  Children that can grow without bound (evidence, reviews, names) are tables
# of their own; only columns bounded by configuration (labels, tags, flags, sources) are nested.
VENUE = f"""
    venue_id string, name string, name_zh string, brand string, outlet string, address string,
    postal_code string, district string, region string, lat double, lng double, phone string,
    website string, booking_url string, google_place_id string, cuisine array<string>,
    price_level int, price_text string, hours {HOURS}, open_weekends boolean, late_night boolean,
    ph_closed boolean, business_status string, michelin string, hygiene_grade string,
    flags map<string,boolean>, ambience_tags array<string>,
    ratings map<string,struct<rating:double,review_count:int>>, social_words long,
    earliest_evidence string, first_seen_run string, last_seen_run string
"""

EVIDENCE = (
    "venue_id string, source_key string, url string, title string, published_at string, "
    "category_keys array<string>, queries array<string>, snippet string, rating double, "
    "review_count int, confidence double, independent boolean, captured_at string, run_id string"
)

REVIEW_SNIPPET = (
    "venue_id string, source string, rating double, published_at string, snippet string"
)

SCORE = (
    "run_id string, category_key string, venue_id string, name string, score double, rank int, "
    "components map<string,double>, adjustments map<string,double>, excluded_reason string, "
    "hidden boolean"
)

MENTION = (
    "source string, platform string, url string, caption string, creator_handle string, "
    "post_date string, venue_id string, matched_by string, match_score double, run_id string, "
    "query string, hashtag string"
)
