"""Social mentions: matching to venues, storing, buzz."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.functions.base import iso_date
from placerank.functions.names import handle_key, name_key
from placerank.functions.similarity import partial_ratio_udf, ratio_udf
from placerank.operators.blocking import best_windows, texts_near
from placerank.operators.ordered import top_k
from placerank.params import BuzzParams
from placerank.session import materialise

HANDLE_THRESHOLD = 90.0
CAPTION_THRESHOLD = 88.0
GUESS_THRESHOLD = 60.0
MIN_KEY = 5
CJK = "[一-鿿]"


def mention_key(source: Column, url: Column, caption: Column) -> Column:
    """Identity of a mention: its url, or the start of its caption when it has none."""
    no_url = F.coalesce(url, F.lit("")) == ""
    return F.concat_ws(
        "\u0001", source, F.coalesce(url, F.lit("")),
        F.when(no_url, F.substring(F.coalesce(caption, F.lit("")), 1, 120)).otherwise(F.lit("")),
    )


def matcher_keys(venues: DataFrame, names: DataFrame) -> DataFrame:
    """(venue_id, name_key, handle_key) for every usable name: own, aliases, Chinese, brand."""
    own = venues.select("venue_id", F.explode(F.array_compact(F.array("name", "name_zh", "brand"))).alias("n"))
    every = own.union(names.select("venue_id", F.col("alias")))
    keyed = every.select("venue_id", name_key(F.col("n")).alias("name_key"), handle_key(F.col("n")).alias("handle_key"))
    return keyed.where((F.length("name_key") >= MIN_KEY) | F.col("name_key").rlike(CJK)).distinct()


def _best(scored: DataFrame, by: str = "key") -> DataFrame:
    """Highest score per mention or text, first venue id on ties."""
    return scored.groupBy(by).agg(
        F.min_by(F.struct("venue_id", "score"), F.struct((-F.col("score")).alias("s"), "venue_id")).alias("b")
    ).select(by, F.col("b.venue_id").alias("venue_id"), F.col("b.score").alias("score"))


def _best_of_texts(scored: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """(haystack, venue_id, score): the best venue of every text, decided once however many mentions say it.

    ``scored``: needle, haystack, score.  Of the venues that share a needle only the first can win, so neither side's
    copies are multiplied."""
    first = keys.where(F.col(column) != "").groupBy(F.col(column).alias("needle")).agg(F.min("venue_id").alias("venue_id"))
    return materialise(_best(scored.join(first, "needle").select("haystack", "venue_id", "score"), "haystack"))


def _guesses_of_texts(scored: DataFrame, keys: DataFrame, column: str, n: int) -> DataFrame:
    """The n best venues of every text; of the venues that share a needle only the first n can be among them."""
    named = keys.where(F.col(column) != "").select(F.col(column).alias("needle"), "venue_id").distinct()
    first = top_k(named, ["needle"], [F.col("venue_id").asc()], n, "_n").drop("_n")
    best = scored.join(first, "needle").groupBy("haystack", "venue_id").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("venue_id").asc()]
    return materialise(top_k(best, ["haystack"], order, n, "_n").drop("_n"))


def _score_pairs(keys: DataFrame, needles: str, texts: DataFrame, least: float = CAPTION_THRESHOLD) -> DataFrame:
    """(needle, haystack, score) of partial ratios between venue keys and mention texts, all of ``least`` and more."""
    pairs = texts_near(
        keys.select(F.col(needles).alias("text")).where("text <> ''"), texts.select("text").where("text <> ''"), least=least
    ).where(F.length("needle") <= F.length("haystack"))
    return pairs.withColumn("score", partial_ratio_udf("needle", "haystack", least))


def match_handles(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, venue_id, score): creator handles equal, close to or containing a venue's handle."""
    handles = mentions.select("key", handle_key(F.col("creator_handle")).alias("h")).where(F.length("h") >= MIN_KEY)
    vk = keys.where("handle_key <> ''")
    pairs = texts_near(
        vk.select(F.col("handle_key").alias("text")), handles.select(F.col("h").alias("text"))
    ).union(
        texts_near(handles.select(F.col("h").alias("text")), vk.select(F.col("handle_key").alias("text")))
        .select(F.col("haystack").alias("needle"), F.col("needle").alias("haystack"))
    ).distinct()
    inside = F.contains("haystack", "needle") & (F.length("needle") >= MIN_KEY)
    scored = pairs.withColumn("r", ratio_udf("haystack", "needle")).select(
        "needle", "haystack",
        F.when(inside, F.greatest("r", F.lit(95.0))).otherwise(F.col("r")).alias("score"),
    ).where(F.col("score") >= HANDLE_THRESHOLD)
    best = _best_of_texts(materialise(scored), vk, "handle_key")
    return _best(handles.join(best.withColumnRenamed("haystack", "h"), "h"))


def match_captions(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, venue_id, score): a venue name inside the caption, or its handle in the hashtags."""
    tags = F.transform(F.regexp_extract_all("caption", F.lit(r"(?U)#([\w一-鿿]+)"), F.lit(1)), handle_key)
    texts = mentions.where("caption is not null").select(
        "key", name_key(F.col("caption"), keep_noise=True).alias("text"), F.array_join(tags, " ").alias("tags")
    )
    names = _score_pairs(keys, "name_key", texts).where(F.col("score") >= CAPTION_THRESHOLD)
    by_name = texts.join(_best_of_texts(names, keys, "name_key").withColumnRenamed("haystack", "text"), "text")
    vk = keys.where(F.length("handle_key") >= MIN_KEY)
    tagged = texts.where("tags <> ''")
    near = texts_near(vk.select(F.col("handle_key").alias("text")), tagged.select(F.col("tags").alias("text")), exact=True)
    hit = near.where(F.contains("haystack", "needle")).withColumn("score", F.lit(96.0))
    by_tag = tagged.join(_best_of_texts(hit, vk, "handle_key").withColumnRenamed("haystack", "tags"), "tags")
    cols = ["key", "venue_id", "score"]
    return _best(by_name.select(*cols).union(by_tag.select(*cols)))


def match_mentions(
    mentions: DataFrame, keys: DataFrame, manual: DataFrame | None = None
) -> DataFrame:
    """Mentions with venue_id, matched_by and match_score: manual, handle, caption, else unmatched."""
    keyed = materialise(mentions.withColumn("key", mention_key(F.col("source"), F.col("url"), F.col("caption"))))
    slim = keyed.select("key", "creator_handle", "caption").distinct()
    options = [
        match_handles(slim, keys).select("*", F.lit(2).alias("tier"), F.lit("handle").alias("how")),
        match_captions(slim, keys).select("*", F.lit(3).alias("tier"), F.lit("caption").alias("how")),
    ]
    if manual is not None:
        known = manual.join(keys.select("venue_id").distinct(), "venue_id", "left_semi")
        options.append(
            keyed.join(known.select("url", F.col("venue_id").alias("_v")), "url")
            .select("key", F.col("_v").alias("venue_id"), F.lit(100.0).alias("score"), F.lit(1).alias("tier"), F.lit("manual").alias("how"))
        )
    every = options[0]
    for o in options[1:]:
        every = every.union(o)
    best = every.groupBy("key").agg(F.min(F.struct("tier", "venue_id", "score", "how")).alias("b"))
    out = keyed.join(best, "key", "left")
    mine = {
        "venue_id": F.col("b.venue_id"),
        "matched_by": F.coalesce("b.how", F.lit("unmatched")),
        "match_score": F.col("b.score"),
    }
    return out.select("key", *[mine.get(c, F.col(c)).alias(c) for c in mentions.columns])


def match_guesses(mentions: DataFrame, keys: DataFrame, n: int = 3) -> DataFrame:
    """(key, venue_id, score, rank): the n best venues for each mention, scores of 60 and more.

    At 60 no trigram need survive, so names are searched in blocks with upper bounds, see :func:`best_windows`.  Handles count
    by their whole ratio."""
    texts = mentions.select(
        "key", name_key(F.coalesce("caption", F.lit("")), keep_noise=True).alias("text"),
        handle_key(F.coalesce("creator_handle", F.lit(""))).alias("h"),
    )
    named = best_windows(keys.select(F.col("name_key").alias("text")).where("text <> ''"), texts.select("text").where("text <> ''"), GUESS_THRESHOLD, n)
    pairs = best_windows(
        keys.select(F.col("handle_key").alias("text")).where("text <> ''"), texts.select(F.col("h").alias("text")).where("text <> ''"), GUESS_THRESHOLD, n, whole=True
    )
    cols = ["key", "venue_id", "score"]
    # what is among the n best by either score is among the n best of its own text
    by_text = texts.join(_guesses_of_texts(named, keys, "name_key", n).withColumnRenamed("haystack", "text"), "text").select(*cols)
    by_handle = texts.join(_guesses_of_texts(pairs, keys, "handle_key", n).withColumnRenamed("haystack", "h"), "h").select(*cols)
    best = by_text.union(by_handle).groupBy("key", "venue_id").agg(F.max("score").alias("score"))
    good = best.where(F.col("score") >= GUESS_THRESHOLD)
    return top_k(good, ["key"], [F.col("score").desc(), F.col("venue_id").asc()], n).withColumn("score", F.round("score", 1))


def upsert_mentions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored and incoming mentions merged by key, with ``change``: new, updated or kept.

    An incoming row replaces a stored one when it brings another match or the first caption.
    Both sides: key, venue_id, matched_by, caption and the same payload columns; ``incoming`` holds
    one row per key (see :func:`latest_mentions`)."""
    s, i = stored.alias("s"), incoming.alias("i")
    matched = F.coalesce(F.col("i.venue_id"), F.lit("")) != ""
    moved = ~F.col("s.venue_id").eqNullSafe(F.col("i.venue_id")) | ~F.col("s.matched_by").eqNullSafe(F.col("i.matched_by"))
    caption = (F.coalesce(F.col("s.caption"), F.lit("")) == "") & (F.coalesce(F.col("i.caption"), F.lit("")) != "")
    change = (
        F.when(F.col("s.key").isNull(), "new")
        .when(F.col("i.key").isNull(), "kept")
        .when((matched & moved) | caption, "updated")
        .otherwise("kept")
    )
    joined = s.join(i, F.col("s.key") == F.col("i.key"), "full_outer").withColumn("change", change)
    take = F.col("change").isin("new", "updated")
    return joined.select(
        *[F.when(take, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in stored.columns], "change"
    )


def latest_mentions(mentions: DataFrame, order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``."""
    rest = [c for c in mentions.columns if c != "key"]
    return mentions.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("key", "r.*").select(
        *mentions.columns
    )


def fill_captions(mentions: DataFrame, answers: DataFrame) -> DataFrame:
    """Captions and creators of caption-less mentions from a keyed answer table."""
    a = answers.select("key", F.col("caption").alias("_caption"), F.col("creator_handle").alias("_creator"))
    empty = F.coalesce("caption", F.lit("")) == ""
    use = empty & (F.coalesce("_caption", F.lit("")) != "")
    return mentions.join(a, "key", "left").select(
        *[
            F.when(use, F.col({"caption": "_caption", "creator_handle": "_creator"}[c])).otherwise(F.col(c)).alias(c)
            if c in ("caption", "creator_handle")
            else F.col(c)
            for c in mentions.columns
        ]
    )


def buzz_scores(mentions: DataFrame, today: str, params: BuzzParams | None = None) -> DataFrame:
    """Decayed mention counts per venue, scaled by the strongest venue.

    ``mentions``: venue_id, url, post_date (ISO text or date), and ``arrival`` deciding which of
    several rows with the same (venue, url) counts."""
    p = params or BuzzParams()
    day = F.lit(today).cast("date")
    known = mentions.where("venue_id is not null and url is not null and url <> ''")
    once = known.groupBy("venue_id", "url").agg(F.min_by("post_date", "arrival").alias("post_date"))
    when = iso_date(F.col("post_date").cast("string"))
    rows = once.select("venue_id", when.alias("posted")).where(
        F.col("posted").isNull() | (F.col("posted") >= F.date_sub(day, p.window_days))
    )
    age = F.date_diff(day, "posted").cast("double")
    weight = F.when(F.col("posted").isNull(), F.lit(p.undated_weight)).otherwise(
        F.pow(F.lit(0.5), age / F.lit(float(p.half_life_days)))
    )
    raw = rows.groupBy("venue_id").agg(
        F.count(F.lit(1)).alias("mentions_window"), F.sum(weight).alias("raw"), F.max("posted").alias("latest")
    )
    top = raw.agg(F.max("raw").alias("top")).scalar()
    return raw.select(
        "venue_id", "mentions_window", "raw",
        F.when(top > 0, F.col("raw") / top).otherwise(0.0).alias("score"),
        (F.col("mentions_window") >= p.trending_threshold).alias("trending"), "latest",
    )


def recent_mentions(mentions: DataFrame, n: int = 8) -> DataFrame:
    """Newest n mentions per venue; undated ones last, earlier arrivals first on equal dates."""
    order = [F.col("post_date").desc_nulls_last(), F.col("arrival").asc()]
    return top_k(mentions.where("venue_id is not null"), ["venue_id"], order, n)


def capped_tags(requests: DataFrame, cap: int = 25, days: int = 7, by: str = "account") -> DataFrame:
    """Rolling cap on distinct tags per account: accepted, repeat or rejected for every request.

    ``requests``: by, tag, at (timestamp), request_id.  A tag used within the last ``days`` is free;
    a new one is accepted while fewer than ``cap`` tags are live.  Each decision depends on the ones
    before it: an account's timeline is folded in ranges, see :func:`fold_ranges`."""
    from placerank.streaming.caps import fold_ranges

    return fold_ranges(requests.select(by, "request_id", "tag", "at"), by, ["at", "request_id", "tag"], cap, days)
