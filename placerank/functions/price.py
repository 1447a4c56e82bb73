"""Price levels and cuisine labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placerank.functions.base import java_quote, lookup, ordered_distinct, strings
from placerank.functions.lexicons import (
    CUISINE_SPELLINGS,
    CUISINE_TABS,
    FOREIGN_MONEY,
    SPECIFIC_CUISINES,
)

SYMBOLS_ONLY = r"(?U)^\s*(\${1,4})\s*$"
MONEY = r"(?iU)(?:S\$|SGD\s*|\$)\s*(\d+(?:\.\d+)?)(?:\s*(?:-|–|to)\s*(?:S\$|\$)?\s*(\d+(?:\.\d+)?))?"
NUMBER_RANGE = r"(?iU)(\d+(?:\.\d+)?)\s*(?:-|–|to)\s*(\d+(?:\.\d+)?)\s*(?:sgd|dollars)"
PER_PERSON = r"(?iU)(\d+(?:\.\d+)?)\s*(?:sgd|dollars|per (?:pax|person|head)|/pax|pp\b)"
# Upper bounds of levels 1 to 3 in dollars per person
LEVEL_BOUNDS = (25, 60, 120)


def _amount(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def price_level(text: Column) -> Column:
    """1..4 from "$$", a dollar amount, the middle of a range or a per-person amount.

    Foreign currencies say nothing about the local level."""
    symbols = F.length(F.regexp_extract(text, SYMBOLS_ONLY, 1))
    foreign = text.rlike("(?U)" + FOREIGN_MONEY) & ~text.rlike(r"(?i)S\$|SGD")
    low, high = _amount(text, MONEY, 1), _amount(text, MONEY, 2)
    r_low, r_high = _amount(text, NUMBER_RANGE, 1), _amount(text, NUMBER_RANGE, 2)
    amount = (
        F.when(low.isNotNull(), F.coalesce((low + high) / 2, low))
        .when(r_low.isNotNull(), (r_low + r_high) / 2)
        .otherwise(_amount(text, PER_PERSON, 1))
    )
    level = F.when(amount > 0, F.lit(1) + sum((amount >= b).cast("int") for b in LEVEL_BOUNDS))
    return F.when(symbols > 0, symbols).when(~foreign, level).cast("int")


def price_symbol(level: Column) -> Column:
    return F.repeat(F.lit("$"), level)


def _canonical(label: Column) -> Column:
    """Exact spelling first, else the first spelling found as a whole word."""
    exact = {s: name for name, spellings in CUISINE_SPELLINGS.items() for s in spellings}
    found = F.lit(None).cast("string")
    for name, spellings in reversed(CUISINE_SPELLINGS.items()):
        pattern = "(?<![a-z])(?:" + "|".join(java_quote(s) for s in spellings) + ")(?![a-z])"
        found = F.when(label.rlike(pattern), F.lit(name)).otherwise(found)
    return F.coalesce(lookup(exact, label), found)


def cuisines(labels: Column) -> Column:
    """Canonical cuisine labels in order; the generic one only when nothing else is known."""
    mapped = ordered_distinct(F.transform(labels, lambda x: _canonical(F.lower(F.trim(x)))))
    specific = F.array_remove(mapped, "Restaurant")
    return F.coalesce(
        F.when(F.size(specific) > 0, specific).otherwise(mapped), F.array().cast("array<string>")
    )


def primary_cuisine(labels: Column) -> Column:
    """The most specific label, else the first."""
    return F.coalesce(
        F.get(F.array_intersect(strings(SPECIFIC_CUISINES), labels), F.lit(0)),
        F.get(labels, F.lit(0)),
    )


def cuisine_tabs(blob: Column) -> Column:
    """Site tabs a place belongs to, in tab order."""
    return F.array_compact(
        F.array(*[F.when(blob.rlike("(?iU)" + p), F.lit(name)) for name, p in CUISINE_TABS.items()])
    )


def bill(level: Column, per_pax: dict[int, float], party_size: Column) -> Column:
    """Estimated bill of a party; null without a price level."""
    return lookup({k: float(v) for k, v in per_pax.items()}, level) * party_size
