"""API payloads and registers -> sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.functions.base import lookup, truthy
from placerank.functions.lexicons import PRICE_ENUM, REVIEW_SOCIAL_WORDS
from placerank.functions.text import clean_snippet, result_date, without_query

PLACES = """
    nextPageToken string, places array<struct<
      id:string, displayName:struct<text:string>, formattedAddress:string,
      addressComponents:array<struct<longText:string,shortText:string,types:array<string>>>,
      location:struct<latitude:double,longitude:double>, nationalPhoneNumber:string,
      websiteUri:string, googleMapsUri:string, reservable:boolean, rating:double,
      userRatingCount:int, priceLevel:string,
      priceRange:struct<startPrice:struct<units:string>,endPrice:struct<units:string>>,
      types:array<string>, regularOpeningHours:struct<weekdayDescriptions:array<string>>,
      businessStatus:string, editorialSummary:struct<text:string>, servesVegetarianFood:boolean,
      goodForChildren:boolean, goodForGroups:boolean, outdoorSeating:boolean, allowsDogs:boolean,
      accessibilityOptions:struct<wheelchairAccessibleEntrance:boolean>,
      reviews:array<struct<rating:double,publishTime:string,text:struct<text:string>>>>>
"""
STATUSES = ["OPERATIONAL", "CLOSED_TEMPORARILY", "CLOSED_PERMANENTLY"]
PLAIN_TYPES = ["cafe", "bar", "bakery", "food_court", "coffee_shop"]


def anonymise_reviews(reviews: Column) -> Column:
    """Rating, date, short snippet and social words; the author is never read from the payload."""

    def one(r: Column) -> Column:
        snippet = clean_snippet(r["text"]["text"])
        words = sum(
            (F.coalesce(F.contains(F.lower(snippet), F.lit(w)), F.lit(False)).cast("int") for w in REVIEW_SOCIAL_WORDS),
            F.lit(0),
        )
        return F.struct(
            r["rating"].alias("rating"), r["publishTime"].alias("published_at"),
            snippet.alias("snippet"), words.alias("social_words"),
        )

    return F.transform(reviews, one)


def places_to_sightings(payloads: DataFrame, source_key: str = "google_places") -> DataFrame:
    """One sighting per place of every payload row (columns of ``PLACES``; others pass through)."""
    keep = [c for c in payloads.columns if c not in ("places", "nextPageToken")]
    p = F.col("p")
    rows = payloads.select(*keep, F.explode("places").alias("p")).where(truthy(p["displayName"]["text"]).isNotNull())
    postal = F.filter(
        F.transform(
            F.filter(p["addressComponents"], lambda c: F.array_contains(c["types"], "postal_code")),
            lambda c: F.coalesce(truthy(c["longText"]), c["shortText"]),
        ),
        lambda t: t.rlike(r"^\d{6}$"),
    )
    units = lambda end: F.coalesce(p["priceRange"][end]["units"], F.lit("?"))
    return rows.select(
        *keep,
        F.lit(source_key).alias("source_key"),
        p["id"].alias("source_ref"),
        p["displayName"]["text"].alias("name"),
        p["formattedAddress"].alias("address"),
        F.get(postal, F.lit(0)).alias("postal_code"),
        p["location"]["latitude"].alias("lat"),
        p["location"]["longitude"].alias("lng"),
        p["nationalPhoneNumber"].alias("phone"),
        p["websiteUri"].alias("website"),
        F.when(p["reservable"], p["googleMapsUri"]).alias("booking_url"),
        p["rating"].alias("rating"),
        p["userRatingCount"].alias("review_count"),
        lookup(PRICE_ENUM, p["priceLevel"]).alias("price_level"),
        F.when(
            p["priceRange"].isNotNull(), F.concat(units("startPrice"), F.lit("-"), units("endPrice"), F.lit(" SGD"))
        ).alias("price_text"),
        F.filter(p["types"], lambda t: t.endswith("_restaurant") | t.isin(*PLAIN_TYPES)).alias("cuisine"),
        F.when(
            p["regularOpeningHours"].isNotNull(),
            F.struct(
                p["regularOpeningHours"]["weekdayDescriptions"].alias("weekday_descriptions"),
                F.lit(None).cast("string").alias("text"),
            ),
        ).alias("opening_hours"),
        F.when(p["businessStatus"].isin(*STATUSES), p["businessStatus"]).alias("business_status"),
        clean_snippet(p["editorialSummary"]["text"]).alias("snippet"),
        F.lit(1.0).alias("confidence"),
        F.struct(
            p["googleMapsUri"].alias("google_maps_uri"),
            p["reservable"].alias("reservable"),
            p["servesVegetarianFood"].alias("serves_vegetarian_food"),
            p["goodForChildren"].alias("good_for_children"),
            p["goodForGroups"].alias("good_for_groups"),
            p["outdoorSeating"].alias("outdoor_seating"),
            p["allowsDogs"].alias("allows_dogs"),
            p["accessibilityOptions"]["wheelchairAccessibleEntrance"].alias("wheelchair_accessible_entrance"),
            anonymise_reviews(p["reviews"]).alias("reviews"),
        ).alias("extra"),
        F.coalesce(
            p["googleMapsUri"], F.concat(F.lit("https://www.google.com/maps/place/?q=place_id:"), p["id"])
        ).alias("page_url"),
    )


def reservable_view(sightings: DataFrame) -> DataFrame:
    """Reservable places again, as booking evidence: maps link, no snippet."""
    uri = F.col("extra.google_maps_uri")
    return sightings.where(F.coalesce("extra.reservable", F.lit(False))).withColumns(
        {
            "source_key": F.lit("google_reserve"),
            "booking_url": uri,
            "snippet": F.lit(None).cast("string"),
            "extra": F.struct(uri.alias("google_maps_uri"), F.lit(True).alias("reservable")),
        }
    )


def title_case(text: Column) -> Column:
    """Every letter run capitalised, also after apostrophes and digits."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 20)))), "")


def catalogue_to_sightings(
    records: DataFrame, columns: dict[str, str] | None = None, source_key: str = "sfa"
) -> DataFrame:
    """Hygiene register rows: enrich-only sightings with confidence 0.

    ``columns`` maps name, address, postal, grade, ref to the register's column names."""
    c = {
        "name": "licensee_name", "address": "premises_address", "postal": "postal_code",
        "grade": "grade", "ref": "_id", **(columns or {}),
    }
    name, postal = F.col(c["name"]), F.col(c["postal"]).cast("string")
    shouting = (F.upper(name) == name) & (F.lower(name) != name)
    padded = F.when(F.length(postal) < 6, F.lpad(postal, 6, "0")).otherwise(postal)
    return records.where(F.trim(name) != "").select(
        F.lit(source_key).alias("source_key"),
        F.coalesce(F.col(c["ref"]).cast("string"), F.lit("")).alias("source_ref"),
        F.when(shouting, title_case(name)).otherwise(name).alias("name"),
        truthy(F.col(c["address"]).cast("string")).alias("address"),
        F.when(postal != "", padded).alias("postal_code"),
        truthy(F.upper(F.trim(F.col(c["grade"]).cast("string")))).alias("hygiene_grade"),
        F.lit(0.0).alias("confidence"),
        F.struct(F.lit(True).alias("enrich_only")).alias("extra"),
    )


# --- social exports ------------------------------------------------------------------------------
PHOTO_ENTRY = (
    "array<struct<title:string,string_map_data:map<string,struct<href:string,value:string,timestamp:long>>,"
    "string_list_data:array<struct<href:string,value:string,timestamp:long>>>>"
)
PHOTO_EXPORT = f"saved_saved_media {PHOTO_ENTRY}, saved_saved_collections {PHOTO_ENTRY}, likes_media_likes {PHOTO_ENTRY}"
VIDEO_EXPORT = (
    "Activity struct<`Favorite Videos`:struct<FavoriteVideoList:array<map<string,string>>>,"
    "`Like List`:struct<ItemFavoriteList:array<map<string,string>>>>"
)
SEARCH_RESULT = "organic_results array<struct<title:string,link:string,snippet:string,date:string>>"
HASHTAG_MEDIA = "data array<struct<id:string,caption:string,permalink:string,timestamp:string>>"

_MENTION = [
    "source", "platform", "url", "caption", "creator_handle", "post_date", "query", "hashtag",
]


def _mentions(df: DataFrame, **columns: Column) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return df.select(*[columns.get(c, nothing).alias(c) for c in _MENTION])


def photo_export_mentions(exports: DataFrame) -> DataFrame:
    """Saved and liked posts of a photo app export (``PHOTO_EXPORT`` columns)."""
    saved = exports.select(F.lit("saved").alias("kind"), F.explode(F.coalesce("saved_saved_media", "saved_saved_collections")).alias("e"))
    liked = exports.select(F.lit("liked").alias("kind"), F.explode("likes_media_likes").alias("e"))
    empty = F.array().cast("array<struct<href:string,value:string,timestamp:long>>")
    items = F.concat(F.coalesce(F.map_values("e.string_map_data"), empty), F.coalesce("e.string_list_data", empty))
    rows = saved.union(liked).select("kind", F.col("e.title").alias("title"), F.explode(items).alias("i"))
    url = F.coalesce(truthy(F.col("i.href")), F.col("i.value"))
    rows = rows.withColumn("url", url).where(F.contains("url", F.lit("instagram.com")))
    return _mentions(
        rows, source=F.lit("ig_export"), platform=F.lit("instagram"), url=without_query(F.col("url")),
        creator_handle=truthy(F.col("title")), query=F.col("kind"),
        post_date=F.to_date(F.timestamp_seconds("i.timestamp")).cast("string"),
    )


def video_export_mentions(exports: DataFrame) -> DataFrame:
    """Favourite and liked videos of a video app export (``VIDEO_EXPORT`` columns)."""
    a = F.col("Activity")
    rows = exports.select(
        F.lit("favourites").alias("kind"), F.explode(a["Favorite Videos"]["FavoriteVideoList"]).alias("e")
    ).union(exports.select(F.lit("liked").alias("kind"), F.explode(a["Like List"]["ItemFavoriteList"]).alias("e")))
    link = F.coalesce(*[truthy(F.try_element_at("e", F.lit(k))) for k in ("Link", "link", "VideoLink")])
    when = F.coalesce(*[truthy(F.try_element_at("e", F.lit(k))) for k in ("Date", "date")])
    rows = rows.withColumns({"url": link, "when": when}).where(F.contains("url", F.lit("tiktok")))
    return _mentions(
        rows, source=F.lit("tiktok_export"), platform=F.lit("tiktok"), url=without_query(F.col("url")),
        post_date=F.substring("when", 1, 10), query=F.col("kind"),
    )


def search_result_mentions(results: DataFrame, limit: int = 10) -> DataFrame:
    """Organic results on a social site; ``results`` also has query and site columns."""
    rows = results.select("query", "site", F.posexplode("organic_results").alias("pos", "r")).where(F.col("pos") < limit)
    rows = rows.where(F.contains("r.link", F.col("site")))
    handle = truthy(F.regexp_extract("r.link", r"(?:instagram\.com|tiktok\.com)/@?([A-Za-z0-9_.]+)", 1))
    text = lambda c: F.coalesce(c, F.lit(""))
    caption = F.trim(F.concat_ws(" ", text(F.col("r.title")), text(F.col("r.snippet"))))
    dated = F.concat_ws(" ", text(F.col("r.date")), text(F.col("r.snippet")))
    return _mentions(
        rows, source=F.lit("serp"),
        platform=F.when(F.contains("site", F.lit("tiktok")), "tiktok").otherwise("instagram"),
        url=without_query(F.col("r.link")), caption=truthy(F.substring(caption, 1, 400)),
        creator_handle=F.when(~handle.isin("p", "reel", "explore", "video"), handle),
        post_date=result_date(dated), query=F.col("query"),
    )


def hashtag_mentions(media: DataFrame) -> DataFrame:
    """Recent posts of a hashtag; ``media`` also has the tag."""
    rows = media.select("tag", F.explode("data").alias("m"))
    return _mentions(
        rows, source=F.lit("ig_hashtag"), platform=F.lit("instagram"), url=F.col("m.permalink"),
        caption=truthy(F.col("m.caption")), post_date=truthy(F.substring("m.timestamp", 1, 10)),
        hashtag=F.lower(F.regexp_replace("tag", "^#+", "")),
    )
