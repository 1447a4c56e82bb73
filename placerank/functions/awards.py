"""Guide awards: reading them from text, levels, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placerank.functions.base import let, lookup
from placerank.functions.lexicons import AWARD_MENTION, OTHER_PLACE, PERSON_AFTER

_CUT = "\u0001"
# Award label -> component value
AWARD_LEVEL = {"Bib Gourmand": 0.5, "Star": 0.7, "1 Star": 0.7, "2 Stars": 0.85, "3 Stars": 1.0}
STAR_WORDS = {"one": 1, "two": 2, "three": 3, "1": 1, "2": 2, "3": 3}


def star_label(count: Column) -> Column:
    return F.concat(count.cast("string"), F.when(count > 1, " Stars").otherwise(" Star"))


def award_from_text(text: Column) -> Column:
    """Award a snippet claims for the place itself, null when none is safe to believe.

    The text is cut at every mention, so each one can be judged with the words before and after it:
    awards of other places, of people, and mentions cut off at the end are passed over."""
    pieces = F.split(F.regexp_replace(text, "(?iU)" + AWARD_MENTION, f"{_CUT}$0{_CUT}"), _CUT)
    return let(pieces, _first_own_award)


def _first_own_award(pieces: Column) -> Column:
    mentions = F.when(F.size(pieces) > 1, F.sequence(F.lit(2), F.size(pieces) - 1, F.lit(2)))

    def in_context(i: Column) -> Column:
        return F.struct(
            F.element_at(pieces, i).alias("hit"),
            F.array_join(F.slice(pieces, F.lit(1), i - 1), "").alias("before"),
            F.substring(
                F.array_join(F.slice(pieces, i + 1, F.size(pieces)), ""), 1, 40
            ).alias("after"),
        )

    def own(m: Column) -> Column:
        sentence = F.right(F.regexp_extract(m["before"], r"(?sU)^(?:.*[.!?]\s)?(.*)$", 1), F.lit(80))
        dangling = F.lower(m["hit"]).endswith("starred") & m["after"].rlike(r"^[ .,]*$")
        return ~(
            sentence.rlike("(?iU)" + OTHER_PLACE)
            | sentence.rlike(r"(?iU)\bof(?: the| a)?\s*$")
            | dangling
            | m["after"].rlike("(?iU)" + PERSON_AFTER)
        )

    def label(hit: Column) -> Column:
        stars = lookup(STAR_WORDS, F.regexp_extract(hit, r"^(one|two|three|[123])[- ]", 1))
        return (
            F.when(hit.startswith("bib"), "Bib Gourmand")
            .when(stars.isNotNull(), star_label(stars))
            .when(hit.isNotNull(), "Star")
        )

    first = F.get(F.filter(F.transform(mentions, in_context), own), F.lit(0))["hit"]
    return let(F.lower(first), label)


def distinction(text: Column) -> Column:
    """Label of a guide card; listed without any award means Selected."""
    low = F.lower(text)
    stars = lookup(
        STAR_WORDS, F.regexp_extract(low, r"(?U)(one|two|three|[123])\s+(?:michelin\s+)?stars?", 1)
    )
    return (
        F.when(F.contains(low, F.lit("bib gourmand")), "Bib Gourmand")
        .when(stars.isNotNull(), star_label(stars))
        .when(F.contains(low, F.lit("green star")), "Green Star")
        .otherwise("Selected")
    )


def award_level(award: Column) -> Column:
    return lookup(AWARD_LEVEL, award)


def star_count(award: Column) -> Column:
    """0 to 3; a star without a number counts as one."""
    numbered = F.regexp_extract(award, r"^(\d).*Stars?$", 1).try_cast("int")
    return F.coalesce(numbered, F.when(award == "Star", 1), F.lit(0))


def award_label(award: Column) -> Column:
    """Award as shown to people; "Selected" and "Green Star" are none."""
    starred = F.contains(award, F.lit("Star")) & (award != "Green Star")
    return F.when(award == "Bib Gourmand", award).when(starred, F.concat(F.lit("Michelin "), award))


def is_buffet(name: Column, cuisine: Column, summary: Column) -> Column:
    text = F.concat_ws(" ", name, F.array_join(cuisine, " "), summary)
    return F.contains(F.lower(text), F.lit("buffet"))


def verdict(
    status: Column,
    rating: Column,
    reviews: Column,
    hygiene: Column,
    award: Column,
    trend: Column,
    best_rank: Column,
    sources: Column,
) -> Column:
    """STRUCT(worth, reason); the first rule that applies decides."""
    enough = F.coalesce(reviews, F.lit(0)) >= 20
    stars = F.format_string("★ %s from %s reviews", rating.cast("string"), reviews.cast("string"))
    label = award_label(award)
    rules = [
        (status.startswith("CLOSED"), False, F.lit("closed")),
        (enough & (rating < 4.0), False, F.concat(F.lit("only "), stars)),
        (F.upper(hygiene).isin("C", "D"), False, F.concat(F.lit("hygiene grade "), hygiene)),
        (label.isNotNull(), True, label),
        (trend == "declining", False, F.lit("rating is falling")),
        (enough & (rating >= 4.2), True, stars),
        (best_rank <= 10, True, F.concat(F.lit("#"), best_rank.cast("string"), F.lit(" on its list"))),
        (sources >= 2, True, F.concat(F.lit("recommended by "), sources.cast("string"), F.lit(" sources"))),
        (F.lit(True), False, F.lit("too little proof yet")),
    ]
    (condition, worth, why), rest = rules[0], rules[1:]
    chain = F.when(condition, F.struct(F.lit(worth).alias("worth"), why.alias("reason")))
    for condition, worth, why in rest:
        chain = chain.when(condition, F.struct(F.lit(worth).alias("worth"), why.alias("reason")))
    return chain
